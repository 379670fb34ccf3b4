"""Column functions on genotype, base, barcode and alignment fields. All stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the IUPAC nucleotide code.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}
COMPLEMENT = ("ACGTRYSWKMBDHVNacgtryswkmbdhvn-", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn-")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gt_alleles(gt: str | Column, keep_half: bool = False) -> Column:
    """struct(a0, a1) of a GT token such as 0/1, 1|1 or 10/2. A half-missing call is missing in both, or kept per allele with ``keep_half``."""
    parts = F.split(_c(gt), r"[/|]")
    one = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"\A\d+\z"), F.get(parts, F.lit(i))).cast("int")
    a0, a1 = one(0), one(1)
    if not keep_half:
        whole = a0.isNotNull() & a1.isNotNull()
        a0, a1 = F.when(whole, a0), F.when(whole, a1)
    return F.struct(a0.alias("a0"), a1.alias("a1"))


def depth(dp: str | Column) -> Column:
    """A DP field as an integer; missing, malformed and negative count as 0."""
    return F.when(_c(dp).rlike(r"\A\d{1,18}\z"), _c(dp)).otherwise("0").cast("long")


def site_quality(qual: str | Column) -> Column:
    """QUAL as a double; a dot, an empty or a malformed field is NaN."""
    return F.coalesce(_c(qual).try_cast("double"), F.lit(float("nan")))


def allele_depths(ad: str | Column) -> Column:
    """AD as array<bigint>, null if any part is missing or malformed."""
    return F.when(_c(ad).rlike(r"\A\d+(,\d+)*\z"), F.transform(F.split(_c(ad), ","), lambda x: x.cast("long")))


def is_het(gt: str | Column) -> Column:
    s = gt_alleles(gt)
    return F.coalesce(s["a0"] != s["a1"], F.lit(False))


def masked_gt(gt: str | Column) -> Column:
    """The missing token with the call's own phase mark."""
    return F.when(F.contains(_c(gt), F.lit("|")), F.lit(".|.")).otherwise("./.")


def genotype_base(b0: str | Column, b1: str | Column) -> Column:
    """One IUPAC letter for two bases; N unless both are A, C, G or T. Both orders of a pair give the same letter."""
    lo, hi = F.least(_c(b0), _c(b1)), F.greatest(_c(b0), _c(b1))
    out = F.when((lo == hi) & lo.isin(*"ACGT"), lo)
    for letter, pair in IUPAC.items():
        out = out.when((lo == pair[0]) & (hi == pair[1]), letter)
    return out.otherwise("N")


def dosage_base(dosage: str | Column, ref: str | Column, alt: str | Column) -> Column:
    """N for a missing dosage, the reference base for 0, the alternative for 2, their IUPAC letter for 1."""
    d = _c(dosage)
    return F.when(d.isNull(), "N").when(d == 0, _c(ref)).when(d == 2, _c(alt)).otherwise(genotype_base(ref, alt))


def base_copies(base: str | Column) -> Column:
    """array of the two allele copies of a base letter: twice a plain base, both bases of a heterozygote, none else."""
    b = F.upper(_c(base))
    out = F.when(b.isin(*"ACGT"), F.array(b, b))
    for letter, pair in IUPAC.items():
        out = out.when(b == letter, F.array(F.lit(pair[0]), F.lit(pair[1])))
    return out.otherwise(F.array().cast("array<string>"))


def is_iupac_het(base: str | Column) -> Column:
    return F.upper(_c(base)).isin(*IUPAC)


def revcomp(seq: str | Column) -> Column:
    return F.reverse(F.translate(_c(seq), *COMPLEMENT))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing characters of two strings of equal length; null for unequal lengths."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(_c(a)) == F.length(_c(b)), n)


def softclip(cigar: str | Column) -> Column:
    """Sum of the S operations of a CIGAR."""
    return F.aggregate(F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)S"), F.lit(1)), F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))


def reference_span(cigar: str | Column) -> Column:
    """Reference bases that a CIGAR covers (M, D, N, = and X)."""
    return F.aggregate(F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))


def edit_distance_tag(tags: str | Column) -> Column:
    """The first NM:i: value of the optional fields, else 0."""
    return F.coalesce(F.regexp_extract(_c(tags), r"(?:\A|\t)NM:i:(\d+)", 1).try_cast("long"), F.lit(0))


def i7_index(header: str | Column) -> Column:
    """The i7 part of a read header: after the last colon, before a plus."""
    return F.split_part(F.regexp_extract(_c(header), r":([^:]*)\z", 1), F.lit("+"), F.lit(1))


def record_type(label: str | Column) -> Column:
    return F.when(F.startswith(_c(label), F.lit("M")), "merged").when(F.startswith(_c(label), F.lit("J")), "joined").otherwise("single")


def marker_id(loc: str | Column, pos: str | Column) -> Column:
    return F.concat(F.lit("loc"), _c(loc).cast("string"), F.lit("_pos"), (_c(pos) + 1).cast("string"))


def newick_label(name: str | Column) -> Column:
    return F.when(_c(name).rlike(r"\A[A-Za-z0-9._-]+\z"), _c(name)).otherwise(F.concat(F.lit("'"), F.replace(_c(name), F.lit("'"), F.lit("''")), F.lit("'")))


def indel_span(pos0: str | Column, ref: str | Column, alt: str | Column) -> Column:
    """struct(start, end) that an indel allele covers: the reference allele of a deletion, one base of an insertion; null for SNPs and *."""
    n = F.length(_c(ref))
    p = _c(pos0)
    return F.when((_c(alt) != "*") & (F.length(_c(alt)) != n), F.struct(p.alias("start"), F.when(F.length(_c(alt)) < n, p + n).otherwise(p + 1).alias("end")))
