"""Orphan references, packed fields and drifting schemas, with their edge cases."""

from datetime import datetime, timezone

import pyarrow as pa
import pytest

from fjordmill.operators import drift, orphans, packed

T = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
A, B, C = "Z1ABC2DEF3", "Z2ABC2DEF3", "Z3ABC2DEF3"
REF = "row_id long, protein_id string, recorded_at timestamp, key string, at long, ref string"
PAR = "accession string, starts timestamp, ends timestamp, key string"


def _run(spark, refs, parents, partitions=3):
    r = spark.createDataFrame([(i, k, t, "x", 1, "y") for i, (k, t) in enumerate(refs)], REF)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PAR)
    return {x.row_id for x in orphans.orphans({"t": (r, "protein_id")}, p, partitions=partitions).collect()}


def test_orphans_follow_spans_and_spelling(spark):
    parents = [(A, T(2), T(5)), (A, T(4), T(8)), (A, T(4), T(8)), (B, T(3), None), (C, None, None), (C, T(9), T(9))]
    refs = [(A, T(1)), (A, T(2)), (A, T(6)), (A, T(8)), (B.lower() + "-2", T(4)), ("sp|" + B + "|X", T(1)), (C, T(9)), (None, T(3)), (" - ", T(3)), ("P12345", T(3)), (B, None), (A, None)]
    assert _run(spark, refs, parents) == {0, 3, 5, 6, 9, 11}


def test_orphans_hot_key_over_many_partitions(spark):
    import random

    rnd = random.Random(3)
    parents = [(A, T(rnd.randint(1, 20)), T(rnd.randint(5, 28))) for _ in range(12)] + [(B, T(10), T(12))]
    refs = [(A if rnd.random() < 0.8 else B, datetime(2024, 1, rnd.randint(1, 30), rnd.randint(0, 23), tzinfo=timezone.utc)) for _ in range(300)]
    want = {i for i, (k, t) in enumerate(refs) if not any(k == a and s <= t < e for a, s, e in parents)}
    for partitions in (1, 2, 9):
        assert _run(spark, refs, parents, partitions) == want


def test_orphans_empty(spark):
    assert _run(spark, [], [(A, T(1), None)]) == set()
    assert _run(spark, [(A, T(1))], []) == {0}


def test_runs_are_merged(spark):
    E = orphans.ENDLESS
    rows = [(1, 1, 3), (1, 2, 9), (1, 10, 12), (1, 14, 20), (1, 14, 15), (2, 5, E), (2, 7, 8), (3, 4, 3), (None, 1, 2), (4, None, 2), (5, -3, -1), (5, 0, 0)] + [(9, k, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, at long, end long")
    got = lambda n: sorted(tuple(r) for r in orphans.runs(df, n).collect())
    want = [(1, 1, 12), (1, 14, 20), (2, 5, E), (5, -3, 0), (9, 0, 999)]
    assert got(1) == want
    assert len(got(8)) < len(want) + 8  # a border may leave a run in two parts
    assert orphans.runs(df.limit(0), 2).count() == 0


def test_missing_integer_keys(spark):
    parents = spark.createDataFrame([(k,) for k in [*range(100, 5000), *range(7000, 7010), None, 100]], "id long")
    refs = spark.createDataFrame([(i, k) for i, k in enumerate([99, 100, 4999, 5000, 7009, 7010, None, -5, 2**62])], "row_id long, to long")
    for n in (1, 7):
        assert sorted(r.row_id for r in orphans.missing(refs, "to", parents, "id", partitions=n).collect()) == [0, 3, 5, 7, 8]


def test_keys_of_any_length(spark):
    keys = ["AB", "ab ", "A" * 12, "A" * 13, "a-b-c", "x" * 5000, ""]
    p = spark.createDataFrame([(k, T(1), None, "clash") for k in keys[2:6]], PAR)
    r = spark.createDataFrame([(i, k, T(2), "x", 1, "y") for i, k in enumerate(keys)], REF)
    assert {x.row_id for x in orphans.orphans({"t": (r, "protein_id")}, p, partitions=3, key=lambda c: c).collect()} == {0, 1}


@pytest.mark.parametrize(
    "text,items",
    [
        (f"{A};{B}", [A, B]), (f'["{A}", "{B}"]', [A, B]), ("0AAA[A,B] | 0BBB", ["0AAA[A,B]", "0BBB"]), ("'0AAA';;'0BBB'", ["0AAA", "0BBB"]),
        ('"a, b";c', ["a, b", "c"]), ('"say ""x"" now"', ['say "x" now']), ("n/a", []), (" ", []), ("", []), ("A;A", ["A", "A"]), ("n/a;A", ["A"]),
        ("A B\tC\nD", ["A", "B", "C", "D"]), ("(A+B)", ["A", "B"]), (";;", []),
    ],
)
def test_packed_codes(text, items):
    assert packed.split_texts(pa.array([None, text, text]), False)[1].to_pylist() == items * 2
    if text != "n/a" and "n/a" not in text:
        assert packed.scan_codes(text) == items


@pytest.mark.parametrize(
    "text,items",
    [
        ("A b [X:1] (1-2), C, d [Y:2, Z:3] (3-4)", ["A b [X:1] (1-2)", "C, d [Y:2, Z:3] (3-4)"]),
        ('"A ""l"" [X:1] (1-2)" / \'B; c [Y:2] (3-4)\'', ['A "l" [X:1] (1-2)', "B; c [Y:2] (3-4)"]),
        ("A [X:1] (1-2) B [Y:2] (3-4)", ["A [X:1] (1-2)", "B [Y:2] (3-4)"]), ("None", []), ("", []),
    ],
)
def test_packed_modules(text, items):
    assert packed.split_texts(pa.array([text]), True)[1].to_pylist() == items == packed.scan_modules(text) or text == "None"


def test_cleaning_an_array_equals_cleaning_items():
    import random

    rnd = random.Random(3)
    items = ["".join(rnd.choices("\"'aé -N/A\t ", k=rnd.randint(0, 6))) for _ in range(3000)] + ["n/a", "NA", "'n/a'", '""', "'", "'" * 4]
    assert packed.clean_items(pa.array(items, pa.large_string())).to_pylist() == [packed._clean(i) for i in items]


def test_packed_rows_positions_and_long_text(spark):
    long = ";".join(f"X{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, "a;b;a", "q"), (2, None, "q"), (3, "", "q"), (4, long, "q")], "row_id long, packed string, item string")
    rows = packed.unpack(df, "packed").collect()
    assert sorted((r.row_id, r.pos, r.item) for r in rows if r.row_id < 4) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a")]
    assert sum(r.row_id == 4 for r in rows) == 50_000
    assert packed.unpack(df.limit(0), "packed").count() == 0


RAW = "record_id long, stream_id string, file_seq long, payload string, type string"


def _raw(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], RAW)


def test_drift_changes(spark):
    rows = [
        ("s", 1, '{"a": {"x": 1, "y": true}, "k": "v", "n": null}'), ("s", 1, '{"a": {"x": 2.5}}'), ("s", 3, '{"a": {"z": 1, "y": "t"}, "k": "v"}'), ("s", 3, "{broken"), ("s", 3, None), ("s", 3, "[1]"),
        ("s", 4, '{"a": {"z": [], "y": "t", "w": {}}, "k": null}'), ("t", 1, '{"a": 1}'), ("s", None, '{"b": 1}'), (None, 1, '{"b": 1}'),
    ]
    got = {(r.stream_id, r.file_seq, r.field_path, r.change, r.renamed_from) for r in drift.changes(_raw(spark, rows)).collect()}
    assert got == {("s", 3, "a.z", "renamed", "a.x"), ("s", 3, "a.y", "type", None), ("s", 4, "a.z", "type", None), ("s", 4, "k", "removed", None)}


RAW2 = "record_id long, stream_id string, file_seq long, payload string, line_no int, loaded_at long, type string"


def test_drift_union_and_records(spark):
    rows = [
        ("s", 1, '{"a": 1, "b": 1, "old": 7, "n": 1}', 1), ("s", 2, '{"a": "x", "b": [2], "new": 8, "n": 2}', 1), ("s", 2, "nope", 2), ("s", 2, '{"a": "x", "b": [2], "new": 8, "n": 2}', 1), ("s", 3, '{"a": true, "new": 9, "f": 1.5}', 1),
        ("t", 1, '{"old": 5, "f": 2}', None), ("t", 1, '{"old": 6}', None), ("u", 1, '{"p": 1}', 1), ("u", 2, '{"q": 1}', 1), ("v", 1, '{"p": 1, "q": 2}', 1), ("s", None, '{"a": 1}', 1),
    ]
    raw = spark.createDataFrame([(i, s, q, p, n, 100 - i, "clash") for i, (s, q, p, n) in enumerate(rows)], RAW2)
    schemas = drift.file_schemas(raw)
    union = sorted((r.field_path, r.type) for r in drift.union_schema(schemas).collect())
    assert ("a", "string") in union and ("b", "array") in union and ("f", "number") in union
    names = drift.columns(schemas, drift.changes(raw, schemas))
    # old became new in one stream, so both are one column everywhere; p and q stand side by side in v, so they stay apart
    assert names == [("a", "a", "string"), ("b", "b", "array"), ("f", "f", "double"), ("n", "n", "long"), ("new", "new", "long"), ("old", "new", "long"), ("p", "p", "long"), ("q", "q", "long")]
    got = {r.record_id: r for r in drift.consistent(drift.once(raw), names).collect()}
    assert sorted(got) == [0, 3, 4, 5, 6, 7, 8, 9]  # 1 came again as 3, which was loaded first
    assert [got[i].new for i in (0, 3, 4, 5, 6)] == [7, 8, 9, 5, 6] and (got[0].a, got[0].b, got[4].a, got[5].f) == ("1", "[1]", "true", 2.0)
    empty = raw.limit(0)
    assert drift.changes(empty).count() == 0 and drift.columns(drift.file_schemas(empty), drift.changes(empty)) == [] and drift.consistent(empty, []).count() == 0


def test_lattice_laws():
    kinds = [None, *drift.RANK]
    for a in kinds:
        for b in kinds:
            assert drift.promote(a, b) == drift.promote(b, a)
            for c in kinds:
                assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c))
