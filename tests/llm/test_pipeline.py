"""Each stage of the pipeline on what the one before kept, against plain readings."""

import os
import re

import pytest
from compare import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

BIG = SF.replace("sf0.001", "sf0.01")


def words5(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(BIG, "documents.parquet"))
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, BIG)
        out.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert result.columns == docs.columns
        seen.append((name, docs, result))
        docs = result
    kept = {name: {r.doc_id: r.text for r in result.collect()} for name, _, result in seen[:-1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(os.path.join(BIG, "labels.parquet")).collect()}
    good = [i for i, q in labels.items() if q > 0]
    assert sum(i in kept["quality"] for i in good) >= 0.95 * len(good)
    same = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(map(same, kept["exact_dedup"].values())) == sorted({same(t) for t in kept["quality"].values()})
    # near copies: what is left holds no linked pair, and each dropped document is linked to another one
    sets = {i: words5(t) for i, t in kept["exact_dedup"].items()}
    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, set()).add(i)
    linked = set()
    for i, s in sets.items():
        for j in set().union(*(inverted[x] for x in s)) if s else ():
            if i < j and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                linked.add((i, j))
    assert not [p for p in linked if p[0] in kept["near_dedup"] and p[1] in kept["near_dedup"]]
    assert set(kept["exact_dedup"]) - set(kept["near_dedup"]) <= {x for p in linked for x in p}
    assert set(kept["pii"]) == set(kept["near_dedup"])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") for t in kept["pii"].values())
    packed = seen[-1][2]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept["pii"])
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def _run_on(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return P.run(spark, str(folder))


def test_odd_rows(spark, docs, rows, tmp_path):
    """Nulls, blanks, very long texts, rows that repeat and columns with the stages' own names, through all stages."""
    labels = [(k * 3, int(len(t or "") > 20), 0) for k, (_, t, *_) in enumerate(rows[:60])] + [(None, 1, 0), (3, None, 0), (99999, 1, 0)]
    packed = _run_on(spark, tmp_path, docs, labels).collect()
    at, read = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = read.collect()
    same = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(same(r.text) for r in at["exact_dedup"]) == sorted({same(r.text) for r in at["quality"]})
    assert len(at["pii"]) == len(at["near_dedup"]) <= len(at["exact_dedup"])
    # the whole run is these stages and packing
    one = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in P.STAGES[-1][1](spark, read, str(tmp_path)).collect())
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == one
    assert {str(r.doc_id) for r in packed} == {str(r.doc_id) for r in at["pii"]}


def test_empty_tables(spark, empty, tmp_path):
    assert _run_on(spark, tmp_path, empty, []).count() == 0
