from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from brute import contamination, near, repeated_lines, sha
from claimloom.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    out = tmp_path_factory.mktemp("corpus")
    words = [f"w{i}" for i in range(600)]

    def text(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))

    docs, labels, items = [], [], [(i, text(3)) for i in range(4)]
    for d in range(400):
        body, bad = text(rng.randint(2, 8)), rng.random() < 0.3
        if d % 10 == 3:
            body = docs[rng.randrange(d)][1]
        if d % 10 == 5:
            body = " ".join(docs[d - 2][1].split(" ")[:-1])
        if d % 10 == 7:
            body += "\n" + items[d % 4][1]
        if d % 10 == 9:
            body += "\nthis is a very common line of ten words here\n" + text(2)
        docs.append((d, body.replace(" ", "### ") if bad else body, "en", f"s{d % 4}", len(body)))
        labels.append((d, int(not bad), 0 if d % 50 else 1))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_each_stage_and_the_whole(spark, folder):
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "near-duplicate removal", "benchmark decontamination", "byte-level BPE"]

    def rows(table):
        assert table.columns == names
        return {r["doc_id"]: r["text"] for r in table.collect()}

    kept = stages["quality classifier"](spark, docs, folder)
    good = {d for d, q in quality.items() if q}
    assert len(rows(kept).keys() & good) >= 0.95 * len(good) and len(rows(kept).keys() & (quality.keys() - good)) <= 0.05 * len(good)

    lined = stages["line dedup"](spark, docs, folder)
    plain = repeated_lines([(d, t) for d, t in rows(docs).items() if t is not None], 10)
    assert rows(lined) == {d: plain[d][2] if d in plain else None for d in rows(docs)}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined.collect())

    single = stages["near-duplicate removal"](spark, docs, folder)
    assert rows(single).keys() == {d for d, (_, root) in near(list(rows(docs).items()), 5).items() if d == root}

    clean = stages["benchmark decontamination"](spark, docs, folder)
    assert rows(clean).keys() == {r[0] for r in contamination(list(rows(docs).items()), items) if not r[5]}

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = stages["byte-level BPE"](spark, docs, folder).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in coded} == {
        d: (other.encode_ordinary(t or ""), sha(t or "")) for d, t in rows(docs).items()
    }

    left = kept
    for name in list(stages)[1:]:
        left = stages[name](spark, left, folder)
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, left.collect()))


def test_clean_rows_stay_beside_bad_ones_of_their_id(spark, tmp_path):
    """Rows that share a doc_id, or have none, are judged each by its own text."""
    own = lambda name: " ".join(f"{name}{i}" for i in range(30))
    docs = [(1, own("a")), (None, own("a")), (None, own("b")), (2, own("a") + " end"), (2, own("c")), (None, own("i")), (3, own("i") + " " + own("d")), (3, own("e"))]
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, own("i"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    single = corpus_pipeline.drop_near_copies(spark, table, str(tmp_path))
    assert rows(single) == sorted((docs[k] for k in (0, 2, 4, 5, 6, 7)), key=repr)
    assert rows(corpus_pipeline.drop_contaminated(spark, table, str(tmp_path))) == sorted((docs[k] for k in (0, 1, 2, 3, 4, 7)), key=repr)
