"""Steps that the workflow hands to external programs. They are not reimplemented; each adapter says so when called."""

from __future__ import annotations

import shutil


class ExternalToolNeeded(RuntimeError):
    """A step needs a program that is not part of this library."""


#: Step, and the kind of program that does it.
STEPS = {"trim": "a read trimmer", "map": "a short-read aligner", "call": "a variant caller", "align": "a multiple sequence aligner", "cluster": "a sequence clusterer", "tree": "a maximum-likelihood tree builder", "species_tree": "a multispecies coalescent sampler", "admixture": "a model-based ancestry estimator", "embed": "a manifold embedding library"}


def run(step: str, program: str | None = None) -> str:
    """The path of an installed ``program`` for ``step``; an error that names what is missing otherwise."""
    if step not in STEPS:
        raise KeyError(step)
    found = program and shutil.which(program)
    if not found:
        raise ExternalToolNeeded(f"{step} needs {STEPS[step]}; give the program's name, its output can be read with locusflow.sources")
    return found
