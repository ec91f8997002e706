"""Manifests: tampered files and groups are found, the order of keys and rows is irrelevant."""

import hashlib
import json
import random

from paperloom.operators import verify as V
from paperloom.plans import verify as P
from pyspark.sql import functions as F


def test_canonical_json_has_one_spelling(spark):
    value = {"b": [1, {"z": None, "a": "é\"x"}], "a": {"y": True, "c": 2}}
    texts = [json.dumps(value), json.dumps({"a": {"c": 2, "y": True}, "b": [1, {"a": "é\"x", "z": None}]}, indent=2, ensure_ascii=False), "{broken", None, ""]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(V.canonical(F.col("t")).alias("c")).collect()]
    assert got[:2] == [json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] * 2 and got[2:] == [None] * 3


def test_digests_ignore_order_and_see_changes(spark):
    rows = [(i, None if i == 3 else f"t{i % 5}", "s" if i % 2 else None) for i in range(40)]
    make = lambda r: V.group_manifest(spark.createDataFrame(r, "id int, text string, source string"), ["source"], F.octet_length("text"), F.col("id").cast("string"), F.col("text"))
    mixed = random.Random(1).sample(rows, len(rows))
    assert {r.errors == [] for r in V.contract_errors(make(rows), make(mixed), ["source"]).collect()} == {True}
    changed = [(i, "" if i == 3 else t, s) for i, t, s in rows]
    assert {r.source: r.errors for r in V.contract_errors(make(rows), make(changed), ["source"]).collect()} == {None: [], "s": ["hash_mismatch"]}
    gone = [r for r in rows if r[2]] + [(99, "new", "other")]
    assert {r.source: r.errors for r in V.contract_errors(make(rows), make(gone), ["source"]).collect()} == {None: ["missing_artifact"], "s": [], "other": ["unlisted_artifact"]}


def test_tampered_files_are_found(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    entries = []
    for name, said, there in (("a.txt", b"one", b"one"), ("sub/b.txt", b"two", b"owt"), ("c.txt", b"three", b"threee"), ("gone.txt", b"x", None), ("manifest.json", b"{}", b"{}"), ("empty", b"", b"")):
        entries.append((name, len(said), hashlib.sha256(said).hexdigest()))
        if there is not None:
            (tmp_path / name).write_bytes(there)
    got = V.file_errors(spark, spark.createDataFrame(entries, "path string, byte_size long, sha256 string"), str(tmp_path))
    assert {r.path: r.errors for r in got.collect()} == {"a.txt": [], "sub/b.txt": ["sha256_mismatch"], "c.txt": ["byte_size_mismatch", "sha256_mismatch"], "gone.txt": ["missing_artifact"], "manifest.json": ["manifest_self_hash_present"], "empty": ["missing_artifact"]}


def test_props_as_plain_python(spark, small):
    def canon(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    import pyarrow.parquet as pq

    want = {}
    for text in pq.read_table(f"{small}/clicks.parquet", columns=["props"]).column("props").to_pylist():
        c = canon(text)
        want.setdefault(c and hashlib.sha256(c.encode()).hexdigest(), []).append(text)
    got = {r.sha256: (r.n, r.spellings) for r in P.canonical_props(spark, small).collect()}
    assert got == {k: (len(v), len(set(v) - {None})) for k, v in want.items()}
