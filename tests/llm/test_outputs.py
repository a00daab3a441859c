"""Operators 9 and 10, and the pipeline."""

from __future__ import annotations

import base64
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing
from lodestone.llm.language_id import identify, learn
from lodestone.llm.mixing import mix, plan
from lodestone.llm.op10_query import op10_mix_sources
from lodestone.llm.op9_query import END_ID, op9_token_files
from lodestone.llm.shared import is_training_row, new_path
from lodestone.llm.token_files import read_token_files, write_token_files
from lodestone.session import shared_folder

from .conftest import SCHEMA, odd_rows, passage, with_extras, words


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def encoded(rows, tokenizer):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, END_ID]
        out.append((r[0], start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark, odd, tokenizer):
    path = new_path(spark, "test-tokens")
    manifest = write_token_files(with_extras(odd, "start", "extra"), path, tokenizer[0], END_ID, sequence_length=64)
    got = sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [(*r[:3], bytes(r[3])) for r in got] == encoded(odd_rows(), tokenizer[1])
    for name in [r.file for r in manifest.collect()]:
        with pa.memory_map(f"{path.removeprefix('file://')}/{name}.arrow") as source:
            table = pa.ipc.open_file(source).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64) and table.schema.field("mask").type == pa.list_(pa.bool_(), 64)
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["mask"].chunks])
        assert not mask[np.argmin(mask) :].any() or mask.all()


def test_no_documents_no_files(spark, empty, tokenizer):
    path = new_path(spark, "test-tokens")
    assert write_token_files(empty, path, tokenizer[0], END_ID).collect() == [] and read_token_files(spark, path).collect() == []


def test_query_9(spark, data, tokenizer):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{data}/documents.parquet").collect()]
    wanted = [(i, s, n, zlib.crc32(b)) for i, s, n, b in encoded(docs, tokenizer[1])]
    assert sorted(map(tuple, op9_token_files(spark, data).collect())) == wanted


def targets(rows):
    """Targets by sharing out what is above the limit again and again."""
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return sizes, target


def mixed_rows():
    return odd_rows() + [(2000 + i, passage(i, 5 + i % 90), "en", f"s{i % 7}" if i % 3 else "hot", 1) for i in range(400)]


def test_targets_and_taken_words(spark):
    rows = mixed_rows()
    slim, draws = plan(spark.createDataFrame(rows, SCHEMA))
    got = draws.assign(slim.select("*", F.lit(1).alias("shards"))).collect()
    sizes, target = targets(rows)
    assert len(got) == len(rows)
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert of[0].source_size == sizes[s] and of[0].target == pytest.approx(target[s])
        taken = sum(r.size * len(r.shards) for r in of)
        assert taken <= target[s] + 1e-6 and target[s] - taken < max(r.size for r in of) + 1
    assert all(len(r.shards) <= 2 for r in got)


def test_reruns_and_other_orders_agree(spark):
    rows = mixed_rows()
    take = lambda frame: sorted((str(r.doc_id), tuple(r.shards)) for r in (lambda s, d: d.assign(s))(*plan(frame)).collect())
    assert take(spark.createDataFrame(rows, SCHEMA)) == take(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))


def test_the_mix_has_each_draw_once(spark):
    frame = spark.createDataFrame(mixed_rows(), SCHEMA)
    got = mix(with_extras(frame, "shard", "target", "extra"))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "target", "extra", "shard", "repeat"]
    slim, draws = plan(frame)
    assert got.count() == draws.assign(slim).agg(F.sum(F.size("shards"))).first()[0]
    shards = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert min(shards) >= 0 and max(shards) < 16


def test_shards_get_sources_in_proportion(spark):
    frame = spark.createDataFrame([(i, passage(i % 50, 900), "en", "ab"[i % 2], 1) for i in range(1200)], SCHEMA)
    got = mix(frame, shards=4).groupBy("shard", "source").count().collect()
    assert len(got) == 8


def test_a_long_document_that_does_not_fit_leaves_little_missing(spark, monkeypatch):
    """The draw goes on behind it, so no more is missing than a thousandth of the target or a short document."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 60)
    rows = [(i, passage(i, 20), "en", "ab"[i % 2], 1) for i in range(300)] + [(1000 + i, passage(1000 + i, 900), "en", "ab"[i % 2], 1) for i in range(6)]
    slim, draws = plan(spark.createDataFrame(rows, SCHEMA))
    got = draws.assign(slim.select("*")).collect()
    for s in "ab":
        of = [r for r in got if r.source == s]
        assert 0 <= of[0].target - sum(r.size * len(r.shards) for r in of) <= max(20, of[0].target / 1000)


def test_a_source_of_many_empty_texts_has_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    frame = spark.createDataFrame([(i, "", "en", "a", 0) for i in range(95)] + [(500, "some words", "en", "a", 1)], SCHEMA)
    slim, draws = plan(frame)
    assert draws.sources.first()["_blocks"] == 10 and draws.assign(slim).agg(F.sum(F.col("size") * F.size("shards"))).first()[0] == 2


def test_partitions_follow_the_order_within_a_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 200)
    frame = spark.createDataFrame(mixed_rows(), SCHEMA)
    got = mix(frame, shards=2).withColumn("part", F.spark_partition_id())
    parts = {}
    for r in got.groupBy("shard", "part").count().collect():
        parts.setdefault(r.shard, []).append(r.part)
    assert set(parts) == {0, 1} and all(len(p) > 20 for p in parts.values()) and max(parts[0]) < min(parts[1])
    assert got.count() == mix(frame).count()


def test_empty_and_wordless_tables(spark, empty):
    assert mix(empty).collect() == []
    slim, draws = plan(spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 1)], SCHEMA))
    assert [(r.size, r.target, r.shards) for r in draws.assign(slim).collect()] == [(0, 0.0, []), (0, 0.0, [])]


def test_query_10(spark, data):
    rows = op10_mix_sources(spark, data)
    total = rows.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[1] - 1.5 * total[0]) < 0.03 * total[0] and rows.filter("taken > 2 * size").count() == 0


def test_pipeline(spark, odd, data):
    docs, seen = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        path = new_path(spark, "test-stage")
        docs.write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
        if name != "piece_sampling":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    letters = sum(any(c.isalpha() for c in r[1] or "") for r in odd_rows())
    near = identify(odd, learn(odd, is_training_row(F.col("doc_id")))).filter(F.col("score") >= corpus_pipeline.MIN_NEARNESS)
    assert seen["language_id"].count() == near.count() and letters - 3 <= near.count() <= letters
    assert seen["substring_dedup"].count() == seen["jaccard_join"].count() < near.count()
    assert seen["piece_sampling"].count() == seen["mixing"].count()


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    rng = random.Random(1)
    junk = {
        "letters": " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(400)),
        "hex": "\n".join(rng.randbytes(32).hex() for _ in range(60)),
        "base64": base64.encodebytes(rng.randbytes(3000)).decode(),
        "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = spark.createDataFrame([(-1 - i, t, None, k, len(t)) for i, (k, t) in enumerate(junk.items())], SCHEMA)
    brief = spark.createDataFrame([(-100, "The end.", None, "brief", 8)], SCHEMA)
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(more).unionByName(brief), "").collect()
    assert not {r.source for r in kept} & set(junk)
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs.select("doc_id").collect()} | {-100}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_language_stage_tells_texts_with_one_id_apart(spark, broadcast):
    """Null ids and repeated rows too, whether the rejected rows are broadcast or shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    good = docs.orderBy("doc_id").first()
    junk = " ".join(random.Random(2).choices("bcdfghjklmnpqrstvwxz", k=400))
    texts = [(7, junk), (7, good.text), (None, junk), (None, good.text), (7, good.text), (None, good.text), (7, None), (None, None), (None, "12 34")]
    more = spark.createDataFrame([(i, t, None, "more", 1) for i, t in texts], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        kept = corpus_pipeline.language_stage(spark, docs.unionByName(more), "")
        assert [(r.doc_id, r.text) for r in kept.filter("source = 'more'").orderBy("doc_id").collect()] == [(None, good.text)] * 2 + [(7, good.text)] * 2
        assert kept.count() == docs.count() + 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_language_stage_leaves_no_texts_on_disk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    tables = lambda: set(Path(shared_folder(spark).removeprefix("file://")).glob("*/*.parquet"))
    before = tables()
    assert corpus_pipeline.language_stage(spark, docs, "").count() == docs.count()
    stored = sum(p.stat().st_size for p in tables() - before)
    assert 0 < stored < 0.1 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_pipeline_of_nothing(spark, empty, data):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.collect() == []


def test_pipeline_runs(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.columns == ["doc_id", "n_pieces", "ids"] and rows.count() > 0
