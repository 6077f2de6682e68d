"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers

from terrane.llm.common import table
from terrane.llm.line_dedup import line_dedup_stage
from terrane.llm.mixing import curriculum_stage
from terrane.llm.ngram_join import ngram_stage
from terrane.llm.packing import pack
from terrane.llm.quality_rules import quality_stage
from terrane.sources.workspace import materialise


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality_stage(docs, table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Documents without their duplicate lines; those with no line left go."""
    return line_dedup_stage(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each class of near copies."""
    return ngram_stage(docs)


def mix(spark, docs, sf_dir):
    """The copies that the mixture takes, in training order."""
    return curriculum_stage(docs)


def packing(spark, docs, sf_dir):
    """Pieces of token sequences, in time slices along the training order, which the files of the stage before hold."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), ordered=bool(docs.inputFiles()))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_copies), ("mixing", mix), ("packing", packing)]

#: Cutoffs, components, links and token ids are not expressible in one SQL text.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage", release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
