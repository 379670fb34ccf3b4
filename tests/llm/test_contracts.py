"""The registered queries against plain Python on whole small tables."""

import hashlib
import html.parser
import math
import random
import zlib
from itertools import combinations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from locusflow.llm import hashtree, htmlcrf, langid, queries, topk, urlrules

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def oracle(name, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    cur = c.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    return sorted(repr(tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names))) for r in cur.fetchall())


def own(name, spark, folder):
    df = queries.QUERIES[name](spark, str(folder))
    return sorted(repr(tuple(r[n] for n in sorted(df.columns))) for r in df.collect())


def test_repeated_vectors_agree_with_sql(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in [*range(60), 3, 3, 20, 20, 41, 0]]
    rows[60:63] = [rows[3], rows[3], rows[20]]  # equal rows; those after them have another vector under the same id
    pq.write_table(pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    assert own("op1_topk_search", spark, tmp_path) == oracle("op1_topk_search", tmp_path, ["embeddings"])
    few = spark.createDataFrame([(0, [1]), (3, [2]), (3, [2]), (5, [1])], "vec_id long, q array<bigint>")
    assert [(x.vec_id, x.score) for x in topk.topk_search(few, few.vec_id == 0).orderBy("rank").collect()] == [(3, 2), (3, 2), (5, 1)]


def test_media_digests_against_plain_python(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_media_columns(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
    of = {}
    for r in got:
        assert of.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_toxicity_on_held_out_documents(spark):
    """Labelled toxic documents without an insult (some 4 %) count as missed."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    held = [(r.predicted, toxic[r.doc_id]) for r in queries.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    found, false = sum(p for p, y in held if y), sum(p for p, y in held if not y)
    assert found >= 0.9 * sum(y for _, y in held) and false <= 0.01 * sum(1 - y for _, y in held)


def planted_urls():
    r = random.Random(8)
    out = []
    for i in range(900):
        bad = i % 6 == 0
        host = f"{r.choice('abc')}.{'spam' if bad and r.random() < 0.9 else r.choice(['good', 'fine'])}.net"
        out.append((i, f"https://{host}/{r.choice('xy')}/{i}.html" + r.choice(["", "?p=1&q=2", "#top"]), bad and r.random() < 0.95))
    out += [(2000 + i, f"https://h.biz/few/{2000 + i}?lone=1", True) for i in range(5)]  # fewer than the least count: no rule
    out += [(3000 + i, f"https://long.io/{3000 + i}?" + "&".join(f"k{k}={i}" for k in range(25)), i < 30) for i in range(33)]  # a template of 25 keys
    return out


def planted_folder(folder):
    rows = planted_urls()
    pq.write_table(pa.table({"page_id": [i for i, _, _ in rows], "url": [u for _, u, _ in rows], "html": [""] * len(rows)}), f"{folder}/pages.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _, _ in rows], "quality": [1] * len(rows), "toxic": [int(b) for _, _, b in rows]}), f"{folder}/labels.parquet")


def test_planted_url_rules_through_the_query(spark, tmp_path):
    planted_folder(tmp_path)
    got = {r.page_id: r for r in queries.op4_url_filters(spark, str(tmp_path)).collect()}
    for i, url, _ in planted_urls():
        assert got[i].mined == (".spam." in url or "long.io" in url), url
        assert got[i].verdict == ("block" if got[i].mined else "allow")


def test_mined_rules_against_brute_force(spark):
    rows = [(u, b) for i, u, b in planted_urls() if i < 3000]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    sets = [(set(r.t), b) for (_, b), r in zip(rows, df.coalesce(1).select(urlrules.tokens(df.url).alias("t")).collect(), strict=True)]
    n, bad, best = len(rows), sum(b for _, b in rows), set()
    need = max(urlrules.LEAST, math.ceil(urlrules.SUPPORT * n))
    names = sorted({t for s, b in sets if b for t in s})
    names = [t for t in names if sum(b for s, b in sets if t in s) >= need]
    for size in (1, 2, 3):
        for c in combinations(names, size):
            hit = [b for s, b in sets if s.issuperset(c)]
            m, x = len(hit), sum(hit)
            if x >= need and x / m >= urlrules.CONFIDENCE and (x * n - m * bad) ** 2 * n / max(m * (n - m) * bad * (n - bad), 1e-9) >= urlrules.CHI2 and not any(set(b) < set(c) for b in best):
                best.add(c)
    assert best and {tuple(r.antecedent) for r in urlrules.mine(df).collect()} == best


def test_url_sql_agrees(spark, tmp_path):
    assert own("op4_url_filters", spark, SF) == oracle("op4_url_filters", SF, ["pages", "labels"])
    rows = [r for r in planted_urls() if r[0] < 3000]
    pq.write_table(pa.table({"page_id": [i for i, _, _ in rows], "url": [u for _, u, _ in rows]}), f"{tmp_path}/pages.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _, _ in rows], "quality": [1] * len(rows), "toxic": [int(b) for _, _, b in rows]}), f"{tmp_path}/labels.parquet")
    assert own("op4_url_filters", spark, tmp_path) == oracle("op4_url_filters", tmp_path, ["pages", "labels"])


def test_rules_leave_clashing_names_alone(spark):
    pages = spark.createDataFrame([(1, "http://z.spam.net/q", "keep", "t"), (2, "", "keep", "t")], "page_id long, url string, tokens string, bad string")
    rules = spark.createDataFrame([(5, ["site:spam.net"])], "rule_id long, antecedent array<string>")
    got = urlrules.matched(pages, rules).orderBy("page_id").collect()
    assert [(r.tokens, r.bad, r.mined) for r in got] == [("keep", "t", True), ("keep", "t", False)]
    assert urlrules.matched(pages.limit(0), rules).count() == 0


def test_numerals_are_no_letters(spark):
    assert not any(map(langid.lettered, ["½", "²", "①", "Ⅻ", "12 ½", "", None, "_", "٣"])) and all(map(langid.lettered, ["½a", "é", "日", "12 x"]))
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["½ ² ① Ⅻ", "words"])] + [(i, t, k, "s", 1) for i in range(2, 12) for t, k in (("some more words", "en"), ("des mots encore", "fr"))], COLUMNS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert got[0] == ("und", 0.0) and got[1][0] != "und"


def test_language_stage_decides_by_its_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, langid.fold("doc_id", 3) != 1)
    strange = spark.createDataFrame([(90001, "съешь же ещё этих мягких французских булок да выпей чаю", None, "s", 1), (90002, "いろはにほへと ちりぬるを わかよたれそ", None, "s", 1)], COLUMNS)
    texts = {r.doc_id: r.text for r in docs.unionByName(strange, True).collect()}
    got = {i: model.recognise(t) for i, t in texts.items()}
    assert not {90001, 90002} & corpus_pipeline.language_stage(spark, docs.unionByName(strange, True), SF).toPandas().doc_id.pipe(set)
    clean = {i for i in texts if i < 90000 and langid.lettered(texts[i])}
    for wanted in (None, {"en", "fr"}):
        kept = {r.doc_id for r in langid.keep(docs.select(*strange.columns).unionByName(strange), model, wanted).collect()}
        assert kept == {i for i, (k, _, like) in got.items() if like >= langid.FLOOR and k != "und" and (wanted is None or k in wanted)}
        assert wanted or kept == clean
    null = docs.select(*strange.columns).withColumn("lang", langid.F.lit(None).cast("string"))
    assert all(r.lang == got[r.doc_id][0] for r in langid.keep(null, model).collect())


def test_dedup_keeps_one_row_of_each_text(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "wholly different words in this one here", "a third text with words of its own"
    rows = [(3, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (9, c, "fr", "t", 2), (9, c, "fr", "s", 2), (9, c, None, "s", 2), (9, c, None, "s", 2)]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(order, COLUMNS).repartition(3), "")
        assert sorted(map(tuple, got.collect())) == [(3, a, "en", "s", 1), (7, b, "en", "s", 1), (9, c, None, "s", 2)]


class Article(html.parser.HTMLParser):
    """Text blocks of the first article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.parts = 0, [], []

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.depth and tag in htmlcrf.BLOCKS:
            self.flush()
        self.depth += tag == "article" or (self.depth > 0 and tag in ("aside", "div", "section"))

    def handle_endtag(self, tag):
        if self.depth and tag in htmlcrf.BLOCKS:
            self.flush()
        self.depth -= self.depth > 0 and tag in ("article", "aside", "div", "section")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_extraction_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op8_html_extraction(spark, SF).collect()}
    assert got.keys() == pages.keys()
    same = 0
    for i, page in pages.items():
        p = Article()
        p.feed(page or "")
        same += got[i] == "\n".join(p.blocks)
    assert same >= 0.98 * len(pages)


@pytest.mark.parametrize("inside", ["<select>", "<select><option>A<option>B", "<svg><title>pic</title>", '<iframe src="x">', "<noscript>", "<template>", "<textarea>x</textarea>"])
def test_unclosed_elements_drop_nothing_else(inside):
    body = ["First long paragraph of the text, it goes on.", "Second paragraph, which is long too and ends.", "Third paragraph of it all."]
    page = f'<html><body><nav><ul><li><a href="#">One</a></ul></nav><article><p>{body[0]}</p>{inside}<p>{body[1]}</p><p>{body[2]}</p></article><footer>Bottom line</footer></body></html>'
    assert htmlcrf.main_text(page, htmlcrf.default_chain()) == "\n".join(body)


def test_shards_against_plain_python(spark):
    def draw(key, name, weight):
        return math.log((int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    def shard(key, node):
        while node.children:
            node = max(node.children, key=lambda c: draw(key, c.name, c.weight)) if len(node.children) > 1 else node.children[0]
        return node.shard

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = {}
    for r in queries.op9_sharding(spark, SF).collect():
        assert (r.shard, r.grown_shard) == tuple(shard(r.doc_id, hashtree.topology(n)) for n in (16, 17))
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(texts)
    assert own("op9_sharding", spark, SF) == oracle("op9_sharding", SF, ["documents"])


def test_pieces_cover_every_document(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, seqs = {}, {}
    for r in queries.op6_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = tok.encode(text, add_special_tokens=False).ids + [0], 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))
            at += n
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_radius_beyond_the_blocks_is_refused(spark):
    from locusflow.llm import simhash

    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), radius=4)
