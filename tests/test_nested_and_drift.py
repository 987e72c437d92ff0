import json

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import rows
from urbanloom.operators.drift import best_matching, canonical_names, field_changes, name_similarity, unified_members, unified_table
from urbanloom.operators.shred import _by_stack, containment, entities, entity_table, owned_scalars, read_json, shred


def test_containment_over_wrappers_lists_and_texts(spark):
    inner = json.dumps([{"id": "4", "x": [[{"id": 5}]]}, {"ref": 9}])
    bodies = [
        (1, json.dumps({"a": {"id": 1, "w": {"list": [{"id": 2, "id_of": 3}, {"content": inner}]}}})),
        (2, json.dumps({"id": 1, "w": [{"id": 2}]})), (2, json.dumps({"id": 8, "w": [{"id": None, "v": {"id": 6}}]})),
        (3, '{"id": 1, "w": {"id": 77'), (4, ""), (5, None), (6, "[]"), (7, '"text"'), (8, '{"id": NaN}'), (9, '{"id": 3, "t": "{not json"}'),
    ]
    df = spark.createDataFrame(bodies, "record_id long, body string")
    found = entities(shred(df, "record_id", "body"))
    want = [(1, 2), (1, 4), (4, 5)]
    assert rows(containment(found)) == want
    assert rows(containment(entities(shred(df, "record_id", "body", ["id"])))) == want
    assert shred(df.limit(0), "record_id", "body").count() == 0


def test_nodes_of_a_record(spark):
    df = spark.createDataFrame([(1, '{"id": 7, "a": [1.50, null, true], "b": {"c": "x"}}')], "record_id long, body string")
    got = {(r["path"], r["kind"], r["scalar"], r["ordinal"]) for r in shred(df, "record_id", "body").collect()}
    assert got == {("", "object", None, 0), ("id", "number", "7", 0), ("a", "array", None, 1), ("a[0]", "number", "1.50", 0), ("a[1]", "null", None, 1), ("a[2]", "boolean", "true", 2), ("b", "object", None, 2), ("b.c", "string", "x", 0)}


def test_very_deep_bodies(spark):
    depth = 30_000
    body = '{"id": 1, "in": ' * depth + '{"id": 2}' + "}" * depth
    assert read_json(body)[0]
    assert not read_json(body[:-1])[0]
    df = spark.createDataFrame([(1, body)], "record_id long, body string")
    assert rows(containment(entities(shred(df, "record_id", "body", ["id"])))) == [(1, 1), (1, 2)]


def test_parser_without_recursion():
    for text in ('{"a": [1, -2.5e3, "x\\u00e4\\n", true, null, {}, []], "b": {"c": {"d": []}}}', "[]", "{}", ' "t" ', "0"):
        assert json.loads(json.dumps(_by_stack(text))) == json.loads(text, parse_int=str, parse_float=str)
    for text in ("", "[", "[1,]", '{"a" 1}', "{1: 2}", "[1 2]", "01", "[]]", '{"a": }', "nul", '["\x01"]'):
        assert not read_json(text)[0]
        try:
            _by_stack(text)
            raise AssertionError(text)
        except ValueError:
            pass


def test_best_matching():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for shape in ((3, 3), (2, 4), (4, 2), (1, 1)):
        w = rng.random(shape).round(3)
        n = max(shape)
        square = np.zeros((n, n))
        square[: shape[0], : shape[1]] = w
        best = max(sum(square[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert abs(sum(w[i, j] for i, j in best_matching(w)) - best) < 1e-9
    assert best_matching(np.zeros((2, 2))) == []


def member(file, pos, top, gml, **fields):
    return (file, pos, json.dumps({top: {"gml_id": gml, **fields}}))


def test_field_changes(spark):
    n = 30
    members = [member(10, i, "m", f"g{i}", height=i + 0.5, use=f"u{i}", gone=i, flag=True) for i in range(n)]
    members += [member(11, i, "core:m", f"g{i}", Height=str(i + 0.5), use=[f"u{i}"], new=i % 2, flag=None if i else False) for i in range(n)]
    members += [member(12, i, "core:m", f"g{i}", Height=str(i + 0.5), use=[f"u{i}"], new=i % 2) for i in range(n)]
    members += [(12, 99, '{"core:m": {"gml_id": "x", "Cut'), (12, 98, None), (12, 97, ""), (12, 96, "[1]"), (13, 0, '{"core:m": 3}'), members[0]]
    files = [(10, "s", 1), (11, "s", 3), (12, "s", 4), (20, "t", 1), (13, "u", 1), (None, "s", 9)]
    m = spark.createDataFrame(members, "file_id long, pos int, body string")
    f = spark.createDataFrame(files, "file_id long, series_code string, delivery_no int")
    changes = field_changes(m, f)
    assert rows(changes) == sorted([
        (11, "renamed", "height", "Height"), (11, "type_changed", "Height", "Height"), (11, "type_changed", "use", "use"), (11, "removed", "gone", ""), (11, "added", "", "new"), (11, "renamed", "m", "core:m"), (12, "removed", "flag", ""),
    ], key=repr)
    assert rows(canonical_names(changes, f).filter("field = 'Height'")) == [(11, "Height", "height"), (12, "Height", "height")]
    assert {r["field"] for r in unified_members(m, f, changes).collect()} == {"gml_id", "height", "use", "gone", "flag", "new"}
    assert field_changes(m.limit(0), f).count() == field_changes(m, f.limit(0)).count() == 0


def test_name_similarity():
    assert name_similarity("core:creationDate", "creation_date") == 1.0 > name_similarity("height", "usage")


def test_renames_in_large_files_are_judged_on_all_members(spark):
    from pyspark.sql import functions as F

    from urbanloom.operators import drift

    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / (1 << 20)
    ids = spark.range(2000).select("id", (part < 0.4).alias("differs")).collect()
    body = lambda i, name, value: '{"m": {"gml_id": "%d", "%s": "%s"}}' % (i, name, value)  # noqa: E731, UP031
    made = [(1, r["id"], body(r["id"], "a", f"v{r['id']}")) for r in ids] + [(2, r["id"], body(r["id"], "b", ("w" if r["differs"] else "v") + str(r["id"]))) for r in ids]
    members = spark.createDataFrame(made, "file_id long, pos int, body string")
    files = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "file_id long, series_code string, delivery_no int")
    assert sorted(tuple(r) for r in drift.field_changes(members, files).collect()) == [(2, "renamed", "a", "b")]


def test_one_table_of_all_members(spark):
    made = lambda *members: [json.dumps({top: m}) for top, m in members]
    first = made(*[("obj", {"gml_id": f"m{i}", "height": i + 0.5, "flag": i % 2 == 0, "pos": i}) for i in range(4)])
    second = made(*[("member", {"gml_id": f"m{i}", "hoehe": f"{i}.5" if i else "tall", "flag": "yes" if i else True, "pos": i}) for i in range(4)]) + ['{"member": {"gml_id": "m9"', None]
    third = made(("member", {"gml_id": "m1", "hoehe": 1.5, "height": "new1", "FLAG": "x"}), ("member", 5))
    bodies = [(f, k, b) for f, part in enumerate((first, second, third)) for k, b in enumerate(part)]
    members = spark.createDataFrame(bodies, "file_id long, pos int, body string")
    files = spark.createDataFrame([(0, "s", 1), (1, "s", 5), (2, "s", 7)], "file_id long, series_code string, delivery_no int")
    # three of four heights agree as text, the field's type changed; a later field took the old name
    changes = field_changes(members, files)
    table, misfits = unified_table(members, files, changes)
    got = {(r["file_id"], r["pos"]): r for r in table.collect()}
    assert len(got) == len(bodies) and {k for k, r in got.items() if not r["readable"]} == {(1, 4), (1, 5)}
    assert dict(table.dtypes)["height"] == "double"
    assert [got[0, 2]["top"], got[1, 2]["top"], got[0, 2]["height~2"], got[2, 0]["height~2"]] == ["obj", "member", None, "new1"]
    assert [got[0, 2]["height"], got[1, 0]["height"], got[1, 2]["height"], got[2, 0]["height"]] == [2.5, None, 2.5, 1.5]
    assert [got[0, 2]["flag~"], got[1, 0]["flag~"], got[1, 1]["flag~"], got[2, 0]["flag~"], got[2, 0]["FLAG"], got[0, 1]["pos~"]] == [True, True, None, None, "x", 1.0]
    assert {(r["file_id"], r["pos"], r["field"], r["text"]) for r in misfits.collect()} >= {(1, 1, "flag", "yes"), (1, 2, "flag", "yes"), (1, 3, "flag", "yes"), (1, 0, "height", "tall")}
    none, _ = unified_table(members.limit(0), files, changes.limit(0))
    assert none.count() == 0


def test_containment_follows_the_parents_of_the_adjacency_table(spark):
    """The nearest object with an id, found by going up the parents of the full table node by node."""
    body = {"id": 1, "a": [{"x": {"id": 2, "t": json.dumps({"deep": [{"id": 3}]})}}, {"id": 4, "b": {"id": None, "c": {"id": 5}}}], "z": {"id": 6}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps([body, {"id": 9}]))], "record_id long, body string")
    want = set()
    for record in (1, 2):
        nodes = {r["node"]: r for r in shred(df.filter(F.col("record_id") == record), "record_id", "body").collect()}
        ids = {r["parent"]: r["scalar"] for r in nodes.values() if r["label"] == "id" and r["kind"] not in ("object", "array", "text")}
        for node in ids:
            up = nodes[node]["parent"]
            while up >= 0 and up not in ids:
                up = nodes[up]["parent"]
            if up >= 0 and ids[up] is not None and ids[node] is not None:
                want.add((int(ids[up]), int(ids[node])))
    assert set(rows(containment(entities(shred(df, "record_id", "body", ["id"]))))) == want == {(1, 2), (2, 3), (1, 4), (1, 6)}


def test_entities_as_a_table(spark):
    bodies = [(1, json.dumps({"id": 1, "name": "old", "size": {"value": 2.50, "uom": "m"}, "Name": "x", "list": [{"v": 1}], "in": {"id": 2, "name": None}})), (2, json.dumps({"id": 1, "name": "new"})), (3, "{broken")]
    df = spark.createDataFrame(bodies, "record_id long, body string")
    table = entity_table(owned_scalars(shred(df, "record_id", "body")), "record_id")
    assert table.columns == ["feature_id", "Name", "name~", "size_uom", "size_value"]
    assert rows(table) == [(1, "x", "new", "m", "2.5"), (2, None, None, None, None)]
    assert entity_table(owned_scalars(shred(df.limit(0), "record_id", "body")), "record_id").count() == 0
