"""Near copies by SimHash over five-word shingles, held against the exact Jaccard similarity of the shingle sets.

Shingles.  Words are those of ``simhash`` (A-Z lower-cased, runs of bytes that are not ASCII white space); a text is the set
of its five-word shingles, each known by a 64-bit hash (a shorter text is one shingle).  Two texts are linked if the Jaccard
similarity of their sets is 0.8 or more, compared in whole numbers.

Fingerprints.  Equal sets are one node before anything is compared.  A node's fingerprint is the SimHash of its set;
the tiled comparison of ``simhash`` links fingerprints within ``NEAR_BITS`` bits.  Its links (and those of equal fingerprints) are
verified on the whole sets.  Sets at a similarity of 0.8 are about ten bits apart, so not every link is found like this.

The rest.  What the fingerprints miss is found by the prefix filter of ``ngram_join``, among sets they left apart: shingles are
ordered rare first, so few sets share a prefix shingle, and only verified links that connect something leave a task.

Defined cases: null and empty texts have the empty set and are copies of each other; rows are told apart by a row key, not
by doc_id, so null and repeated doc_ids lose no row; empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.llm.common import keyed, utf8
from hushline.llm.ngram_join import GROUP, Rule, Shingler, classes
from hushline.llm.simhash import links as near_fingerprints
from hushline.session import stored

NEAR_BITS = 6
HOT_ROWS = GROUP
RULE = Rule(size=5, num=4, den=5)


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    return Shingler(RULE.size)(text)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are equal or connected within ``NEAR_BITS`` bits; ``prints`` has key and fp."""
    heads = stored(prints.groupBy("fp").agg(F.min("key").alias("head")), "prints")
    near = near_fingerprints(heads.select("fp"), heads.count(), NEAR_BITS)
    head = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    pairs = near.toDF("_a", "_b").join(head("_a", "x"), "_a").join(head("_b", "y"), "_b")
    equal = prints.join(heads, "fp").where("key <> head").select(F.col("head").alias("x"), F.col("key").alias("y"))
    return pairs.select("x", "y").union(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def copies(texts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key`` of each row of ``texts`` (key, ``_text``) that an equal or linked row of a smaller key makes superfluous."""
    return classes(texts, RULE, hot_rows, empty_alike=True, near=fingerprint_links).where("key <> label").select("key")


def drop_near_copies(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null ids being last."""
    rows = keyed(docs)
    gone = copies(rows.select(F.col("_key").alias("key"), utf8("_row.text").alias("_text")), hot_rows)
    return rows.join(gone.select(F.col("key").alias("_key")), "_key", "left_anti").select("_row.*")
