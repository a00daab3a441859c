"""Columns named as the operators' own, in other case, beside the input's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, jaccard_join, language_id, mixing, piece_sampling, quality_knn, quality_rules, simhash, substring_dedup, url_filter
from lodestone.llm.op3_query import model_path
from lodestone.llm.shared import beside, is_training_row


def good(odd):
    return odd.filter("length(text) < 2000")


def identified(odd):
    return language_id.identify(odd, language_id.learn(good(odd).select("doc_id", "text", "lang"), is_training_row(F.col("doc_id"))))


def judged(odd):
    docs = good(odd).select("doc_id", "text")
    labels = docs.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("label")).filter("doc_id IS NOT NULL")
    return quality_knn.judge(odd, quality_knn.learn(docs, labels))


def filtered(odd):
    return url_filter.judge(odd.withColumn("url", F.concat(F.lit("http://a.net/"), F.col("doc_id").cast("string"))), [("block", "net/")])


def assigned(odd):
    return mixing.plan(odd.select("doc_id", "text", "source"))[1].assign(odd)


def decoded(odd):
    return piece_sampling.decode(piece_sampling.encode(odd.filter("length(text) < 2000"), model_path()).drop("DECODED_"), model_path())


#: Operators by their own names (in other case than they write them), and what they add.
CASES = {
    identified: (("LANG_PRED", "Score", "JUDGED"), ("lang_pred", "score")),
    judged: (("SCORE", "Predicted"), ("score", "predicted")),
    filtered: (("HOST", "Path", "RULE", "Verdict", "SCORE", "SAID"), ("host", "path", "rule", "verdict", "score")),
    lambda odd: piece_sampling.encode(odd.filter("length(text) < 2000"), model_path()): (("IDS", "N_Pieces", "SEED"), ("ids", "n_pieces")),
    decoded: (("Decoded", "SEED"), ("ids", "n_pieces", "decoded")),
    substring_dedup.remove_repeats: (("N_WORDS", "N_Removed", "KEPT_TEXT", "_KEY", "_Known"), ("n_words", "n_removed", "kept_text")),
    quality_rules.judge: (("N_WORDS", "KEPT", "Distance2", "BASE_FAILED", "_Words"), None),
    fingerprints.sketches: (("SKETCH", "Least", "_WORDS", "_Hashes"), ("sketch", "least")),
    mixing.mix: (("SHARD", "Repeat", "_KEY"), ("shard", "repeat")),
    assigned: (("_KEY", "_Source", "_block", "_LAST", "Target", "SHARDS", "_blocks"), ("source_size", "target", "shards")),
    jaccard_join.keep_one: (("_KEY", "SET", "Cluster", "_row"), ()),
    simhash.fingerprints: (("FINGERPRINT", "_Text", "_REST"), ("fingerprint",)),
}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_names_in_other_case(odd, number):
    operator, (names, new) = list(CASES.items())[number]
    found = operator(odd.withColumns({n: F.lit(7) for n in names}))
    assert found.count() > 0 and len({c.lower() for c in found.columns}) == len(found.columns)
    if new is not None:
        kept = [n for n in names if n.lower() not in new]
        assert [c for c in found.columns if c in kept or c in new] == [*[n for n in names if n in kept and n in found.columns], *new]
        assert all(r[0] == 7 for n in kept if n in found.columns for r in found.select(f"`{n}`").distinct().collect())


def test_beside():
    assert beside(["a", "B", "c.d", "É"], "b", "C.D") == ["a", "É"]
