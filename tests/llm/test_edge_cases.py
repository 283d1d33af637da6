"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for all operators and stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, h int, line string, component string, score string, kept string, n_words string, `group` int, id string, side string, epoch string, rank string"


def some_text(rng, words=60):
    return "\n".join(" ".join("".join(rng.choice("abcdefghiklmnorstuv") for _ in range(rng.randint(2, 9))) for _ in range(words // 3)) for _ in range(3))


def awkward(spark, tmp_path):
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(20, texts[0], "en", "src1"), (20, texts[0], "en", "src1"), (21, texts[1] + " end", "de", None), (None, texts[2], None, "src1"), (None, None, None, None)]
    rows += [(30, None, "en", "src0"), (31, "", "en", "src0"), (32, " \n\t\n ", "fr", "web"), (33, "é", "fr", "src2"), (34, "x" * 300_000, "en", "src2"), (35, "ab " * 100_000, "en", "src2"), (36, "naïve – 😀 " * 40, "es", "src2")]
    full = [(*r, None, "r", 1, "l", "c", "s", "k", "n", 7, "i", "d", "e", "k") for r in rows]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return awkward(spark, tmp_path_factory.mktemp("awkward"))


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def labels(spark, n=12):
    return spark.createDataFrame([(i, 1 if i % 4 else 0, None) for i in range(n)] + [(None, 1, 0), (50, None, 1)], "doc_id long, quality int, toxic int")


def test_quality_rules(docs, none):
    from touchline.llm.lines_rules import apply_rules

    out = apply_rules(docs)
    assert out.count() == docs.count()
    by = {r["doc_id"]: r for r in out.filter("doc_id is not null").collect()}
    assert by[30]["n_words"] == by[31]["n_words"] == 0 and by[30]["base_failed"] and not by[30]["kept"]
    assert by[35]["n_repeat_words"] == 100_000 and by[33]["word_chars"] == 1
    assert apply_rules(none).count() == 0


def test_near_duplicates(docs, none):
    from touchline.llm.near_dups import drop_near_duplicates, near_duplicates

    out = near_duplicates(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and sum(r["first_row"] for r in rows) == len(drop_near_duplicates(docs).collect())
    by = {r["doc_id"]: r for r in rows}
    assert by[20]["component_id"] == 0 and by[21]["component_id"] == 1 and not by[20]["kept"] and by[30]["kept"]
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["n_shingles"]] == [2]
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_suffix_dedup(docs, none):
    from touchline.llm.suffix_dedup import remove_repeats

    out = remove_repeats(docs).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[31]["n_bytes"] == by[30]["n_removed"] == 0 and by[34]["n_removed"] == 299_999
    twenty = [r["n_removed"] for r in out if r["doc_id"] == 20]
    assert twenty[0] == twenty[1] > 0
    assert remove_repeats(none).count() == 0


def test_line_dedup(docs, none):
    from touchline.llm.line_dedup import dedup_lines

    out = dedup_lines(docs).collect()
    assert len(out) == docs.count() and {c for c in docs.columns} <= set(out[0].asDict())
    by = {r["doc_id"]: r for r in out}
    assert by[0]["n_removed_lines"] == 0 and by[20]["text"] == "" and by[30]["text"] is None
    assert dedup_lines(none).count() == 0


def test_mixing(docs, none):
    from touchline.llm.mixing import mix, mix_ids

    taken = mix(docs, share=1.0, max_epochs=1)
    assert taken.filter("n_chars is not null").count() == 0 and taken.columns[-1] == "epoch"
    with_words = docs.filter(r"text rlike '\\S'").count()
    assert with_words - 3 <= taken.count() <= docs.count()
    # one text holds nearly all words and doesn't fit; the others may come in two epochs
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.select("text").collect())
    some = mix_ids(docs, share=0.3).collect()
    assert some and 35 not in {r["doc_id"] for r in some} and {r["epoch"] for r in some} <= {0, 1}
    assert sum(r["n_tokens"] for r in some) <= 0.3 * words
    assert len([r for r in some if r["epoch"] == 0 and r["n_tokens"]]) < with_words  # texts without words cost nothing
    assert mix(none).count() == 0


def test_quality_model(spark, docs, none):
    from touchline.llm.quality_model import score, train

    model = train(docs, labels(spark))
    out = score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert score(none, train(none, labels(spark).limit(0))).count() == 0


def test_packing(docs, none):
    from touchline.llm.packing import pack

    rows = pack(docs).collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] in (30, 31)] == [[0], [0]]
    assert pack(none).count() == 0


@pytest.mark.parametrize("name", ["secrets", "personal"])
def test_native_scans(docs, none, name):
    from touchline.llm import pii_scan, secret_scan

    run = {"secrets": lambda d: secret_scan.digest(secret_scan.find_secrets(d)), "personal": lambda d: pii_scan.digest(pii_scan.find_personal_data(d))}[name]
    out = run(docs)
    assert out.count() == docs.count() and out.filter("spans is null or base_sha256 is null").count() == 0
    assert run(none).count() == 0


def test_embeddings(spark, tmp_path):
    from touchline.llm.embedding_dups import near_duplicates

    rng = random.Random(3)
    v = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(10, v[0], 1), (10, v[0], 1), (11, v[0], 2), (12, v[0], None), (13, None, 1), (14, [0.0] * 8, 1), (15, [None] * 8, 1), (16, [float("nan")] * 8, 1), (17, [1.0, 2.0], 1), (None, v[1], 1), (18, [float("inf")] + [1.0] * 7, 1)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    e = spark.read.parquet(path)
    out = near_duplicates(e).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows) and got[0] == (2, 0, True) and got[10] == (2, 0, False) and got[None][:2] == (1, 1)
    assert all(got[i] == (0, i, True) for i in (2, 11, 12, 13, 14, 15, 16, 17, 18))
    assert near_duplicates(e.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    base = str(tmp_path)
    labels(spark).write.parquet(f"{base}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        if name != "pack":
            assert out.count() <= docs.count()
            assert out.columns == docs.columns
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        else:
            assert {"sequence_id", "offset"} <= set(out.columns)
            vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokens = [1 + len(vocabulary.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.select("text").collect()]
            assert out.count() == sum(-(-n // 1024) for n in tokens)
    assert corpus_pipeline.ORACLE_SQL is None and F is not None
