"""Water-filling against repeated sharing, and the pipeline against a plain version of all five stages."""

import hashlib
import os
import random
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from batchkeeper.llm import mixing
from batchkeeper.llm.quality import quality_rules
from batchkeeper.llm.queries import ORACLE, QUERIES
from batchkeeper.llm.secrets import redacted, scan
from tests_support import groups_of, near, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared_out(sizes):
    """Targets by sharing again and again until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def plain_mix(docs):
    """doc index -> repetitions, by one pass over each source in the order of its keys."""
    size = [len(WORDS.findall(d[1] or "")) for d in docs]
    key = [
        hashlib.md5(f"mix-1:{'' if d[0] is None else d[0]}:{hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest() for d in docs
    ]
    totals = defaultdict(int)
    for d, n in zip(docs, size, strict=True):
        totals[d[3]] += n
    goals = shared_out(totals)
    out = [0] * len(docs)
    for source, total in totals.items():
        whole = int(goals[source] // total) if total else 0
        extra = goals[source] - whole * total
        rows = [i for i, d in enumerate(docs) if d[3] == source]
        upto = 0
        for i in sorted(rows, key=lambda i: key[i]):
            again = size[i] > 0 and upto + size[i] / 2 <= extra
            out[i] = whole + again
            if size[i] and not again:
                extra = -1  # the draw ends here
            upto += size[i]
    return size, totals, goals, out


def documents(n=240, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(2500)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 160)))
        if i % 6 == 0:
            text = " ".join(w + "***" for w in text.split())
        if i % 5 == 1:
            text = near(rows[-1][1], rng, 1)
        if i % 11 == 2:
            text += f" password=abc{i:08d} key dGhpc0lzQVNlY3JldEtleTEyMzQ1Njc4OTA{i % 3}"
        rows.append((i, text, "aa", rng.choice(["s1", "s2", "s3", "tiny", None]) if i > 2 else "tiny", len(text)))
    return rows


def test_targets_and_repetitions_equal_the_plain_version(spark):
    docs = documents() + [(500, None, "aa", "none", 0), (501, "", "aa", "none", 0), (None, "a b c", "aa", "s1", 5), (7, "x y", "aa", "s2", 3)]
    size, totals, goals, often = plain_mix(docs)
    table = spark.createDataFrame([(*d, 0.5) for d in docs], SCHEMA + ", target double").repartition(5)
    got = mixing.mix(mixing.measured(table)).collect()
    found = sorted((str(r.doc_id), str(r.source), r.mix_size, r.source_size, r.repetitions, r.taken) for r in got)
    assert found == sorted(
        (str(d[0]), str(d[3]), n, totals[d[3]], k, n * k) for d, n, k in zip(docs, size, often, strict=True)
    )
    assert all(abs(r.target - goals[r.source]) <= 1e-6 * max(1, goals[r.source]) for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.mix_size
    assert all(abs(taken[s] - goals[s]) <= max(size) for s in totals)
    assert mixing.mix(mixing.measured(table.limit(0))).collect() == []


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5, 5, 5], [10**9, 3, 10**6, 7, 0], [1], [0, 0]])
def test_water_level(spark, sizes):
    names = {f"s{i}": n for i, n in enumerate(sizes)}
    table = spark.createDataFrame([(s, n, "0") for s, n in names.items()], "source string, mix_size long, mix_key string")
    got = {r.mix_source: r.target for r in mixing.targets(table).collect()}
    want = shared_out(names)
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in names)
    assert abs(sum(got.values()) - sum(sizes)) <= 1e-9 * max(1, sum(sizes))


def test_hot_ids_are_drawn_row_by_row(spark):
    rng = random.Random(3)
    docs = [(7, "same words here " * 3, "aa", "s1", 0)] * 400 + [(8, f"text {i} of one id", "aa", "s1", 0) for i in range(300)]
    docs += [(None, "no id at all", "aa", "s1", 0)] * 200 + [(i + 100, "w " * rng.randrange(1, 30), "aa", "s2", 0) for i in range(900)]
    size, totals, goals, often = plain_mix(docs)
    got = mixing.mix(mixing.measured(spark.createDataFrame(docs, SCHEMA).repartition(6))).collect()
    found = Counter((r.doc_id, r.text, r.repetitions) for r in got)
    assert found == Counter((d[0], d[1], k) for d, k in zip(docs, often, strict=True))
    for s in totals:
        assert abs(sum(r.taken for r in got if r.source == s) - goals[s]) <= max(n for n, d in zip(size, docs, strict=True) if d[3] == s)


def test_columns_that_clash_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "aa", "s1", 3), (2, "c", "aa", None, 1)], SCHEMA)
    taken = ("mix_cut", "mix_wanted", "mix_row", "again", "mix_source", "mix_size", "mix_key", "target", "weight", "whole", "taken", "source_size", "repetitions")
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in taken])
    got = mixing.mix(mixing.measured(clashing)).select("doc_id", "mix_size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(mixing.measured(docs)).select("doc_id", "mix_size", "source_size", "target", "taken").collect()))


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    docs = documents() + [(600, None, None, "s1", None), (601, "", "aa", "s1", 0), (None, documents(1, 99)[0][1], "aa", "s2", 9)]
    docs += [docs[10], docs[10]]  # rows that repeat
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 240) if i % 2 or i % 4 == 0], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    judged = quality_rules(spark.createDataFrame(docs, SCHEMA), labels).collect()
    verdict = {r.doc_id: r.kept for r in judged}
    kept = [d for d in docs if verdict[d[0]]]
    assert {d[0] for d in docs if d[0] is not None and d[0] < 240 and d[0] % 6 and d[0] % 5 != 1} <= {d[0] for d in kept}
    sets = {d[0]: shingles(d[1]) for d in kept}
    groups = groups_of(sorted(i for i in sets if i is not None), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    one = {}
    for d in kept:
        if d[0] is None or groups.root(d[0]) == d[0]:
            one[d[0]] = d
    clean = []
    for d in one.values():
        spans = scan(pa.array([d[1]]))[0]
        clean.append((d[0], redacted(d[1], spans) if spans else d[1], d[2], d[3]))
    assert any("[secret]" in d[1] for d in clean) and not any("password=" in d[1] for d in clean)
    _, _, _, often = plain_mix(clean)
    want = Counter()
    for d, k in zip(clean, often, strict=True):
        ids = [*tokenizer.encode(d[1], add_special_tokens=False).ids, 0]
        want[(d[0], np.array(ids, dtype="<u4").tobytes())] += k
    want = +want
    found = Counter()
    whole = b""
    for r in sorted(got, key=lambda r: r.sequence_id):
        whole += bytes(r.tokens)
        if r.start + r.length == r.doc_tokens:
            found[(r.doc_id, whole)] += 1
            whole = b""
    assert found == want


def test_stages_keep_the_columns(spark, tmp_path):
    extra = [F.lit(1).alias(c) for c in ("kept", "redacted", "target", "repetitions", "mix_size", "row", "copy", "tokens")]
    docs = spark.createDataFrame(documents(30), SCHEMA).select("*", *extra)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
        assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]


def test_mixing_equals_its_sql(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import oracle_compare

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    name = "op10_mixing"
    assert oracle_compare.compare(spark, oracle_compare.duck(sf), sf, name, QUERIES[name], ORACLE[name]) is None


def test_rest_imports_without_the_corpus_part(tmp_path):
    root = Path(__file__).resolve().parents[2]
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(root / "__spark_entry__.py", copy)
    shutil.copytree(root / "batchkeeper", copy / "batchkeeper", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'all_checks' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_only_copies_go(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, texts[0]), (2, texts[0] + " end"), (2, texts[1]), (2, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "s", "xx", 9) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(3), "").select("doc_id", "text").collect()
    want = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (3, ""), (None, texts[3])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
