"""Schemas that drift between the files of a series.

Each file's fields are profiled (JSON types). All pairs of a field that went and one that came between neighbouring files
are checked exactly on all members that both files hold, and a bipartite matching per pair of files decides the renames. Matched fields then share
one name.
"""

from __future__ import annotations

import difflib
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.session import cut, small


def member_fields(members: DataFrame, file_id: str, pos: str, body: str) -> DataFrame:
    """Fields of each readable member: file_id, gml_id, top, pos, field, kind, text.

    field null: the row of the member itself. kind is the JSON type, null for a JSON null; text is the value as written
    (strings without quotes). A body that is null, empty, cut off or no JSON object gives nothing; one whose top-level
    value is no object gives only the row of the member.
    """
    parsed = members.select(F.col(file_id).alias("file_id"), F.col(pos).alias("pos"), F.explode(F.from_json(F.col(body), "map<string,string>")).alias("top", "inner"))
    maps = parsed.withColumn("texts", F.from_json("inner", "map<string,string>")).withColumn("variants", F.from_json("inner", "map<string,variant>"))
    rows = maps.select("file_id", "pos", "top", F.element_at("texts", "gml_id").alias("gml_id"), "variants", F.explode_outer("texts").alias("field", "text"))
    kind = F.regexp_extract(F.schema_of_variant(F.element_at("variants", F.col("field"))), "^[A-Z]+", 0)
    named = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT"), "number").when(kind != "VOID", F.lower(kind))
    return rows.select("file_id", "gml_id", "top", "pos", "field", named.alias("kind"), F.when(named.isNotNull(), F.col("text")).alias("text"))


def name_similarity(a: str, b: str) -> float:
    """How alike two field names are, from 0 to 1, without regard to case, separators and a namespace prefix."""
    flat = lambda s: "".join(c for c in s.rpartition(":")[2].lower() if c.isalnum())
    return difflib.SequenceMatcher(None, flat(a), flat(b)).ratio()


def best_matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with the largest sum of weights; pairs of weight 0 or less are left out.

    The Hungarian method with potentials, O(n^3) for n fields.
    """
    rows, columns = weights.shape
    n = max(rows, columns)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : rows + 1, 1 : columns + 1] = -np.maximum(weights, 0)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, back, seen = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j]:
            seen[j] = True
            slack = cost[owner[j]] - u[owner[j]] - v
            better = ~seen & (slack < least)
            better[0] = False
            least[better], back[better] = slack[better], j
            free = np.where(seen, np.inf, least)
            free[0] = np.inf
            nxt = int(np.argmin(free))
            delta = free[nxt]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j = nxt
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    return [(owner[j] - 1, j - 1) for j in range(1, n + 1) if owner[j] <= rows and j <= columns and weights[owner[j] - 1, j - 1] > 0]


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """Renames among the checked pairs (file_id, old_field, new_field, n, agree) of one file."""
    old, new = sorted(set(pdf["old_field"])), sorted(set(pdf["new_field"]))
    weights = np.zeros((len(old), len(new)))
    for a, b, n, agree in zip(pdf["old_field"], pdf["new_field"], pdf["n"], pdf["agree"], strict=True):
        if 2 * agree > n:
            weights[old.index(a), new.index(b)] = 1 + agree / n + 0.1 * name_similarity(a, b) + 0.001 * min(n, 100)
    pairs = best_matching(weights)
    return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "old_field": [old[i] for i, _ in pairs], "new_field": [new[j] for _, j in pairs]}).astype({"file_id": "int64", "old_field": object, "new_field": object})


def _numbered(files: DataFrame) -> DataFrame:
    """Files (file_id, prev_id), each with the file before it in its series; files without readable member count, too."""
    order = W.partitionBy("series_code").orderBy("delivery_no", "file_id")
    return files.dropna(subset=["file_id", "series_code", "delivery_no"]).dropDuplicates(["file_id"]).withColumn("prev_id", F.lag("file_id").over(order)).select("file_id", "series_code", "delivery_no", "prev_id")


def field_changes(members: DataFrame, files: DataFrame, file_id: str = "file_id", pos: str = "pos", body: str = "body") -> DataFrame:
    """Changes (file_id, change_kind, old_field, new_field) of every file against the one before it in its series.

    files: file_id, series_code, delivery_no. A file without readable members has no fields. Where a field has several JSON
    types in a file, its commonest counts (of equally common ones the first by name). A file that is the first of its
    series, or that has no series or number, gives no changes. A member that is twice in a file counts by its first place.
    """
    fields = cut(member_fields(members, file_id, pos, body))
    chain = cut(_numbered(files))
    per_kind = fields.filter(F.col("field").isNotNull()).groupBy("file_id", "field", "kind").agg(F.count("*").alias("n"))
    profile = cut(per_kind.groupBy("file_id", "field").agg(F.min_by("kind", F.struct(F.col("kind").isNull(), -F.col("n"), F.col("kind"))).alias("kind")))
    before = chain.filter(F.col("prev_id").isNotNull()).select("file_id", "prev_id")
    now = before.join(profile, "file_id").select("file_id", "field", F.col("kind").alias("new_kind"), F.lit(True).alias("is_new"))
    then = before.join(profile.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "field", F.col("kind").alias("old_kind"), F.lit(True).alias("is_old"))
    both = cut(now.join(then, ["file_id", "field"], "full"))
    gone = both.filter(F.col("is_new").isNull()).select("file_id", "prev_id", F.col("field").alias("old_field"), "old_kind")
    new = both.filter(F.col("is_old").isNull()).select("file_id", F.col("field").alias("new_field"), "new_kind")
    pairs = cut(gone.join(new, "file_id").select("file_id", "prev_id", "old_field", "new_field", "old_kind", "new_kind"))
    # the exact check: values of the candidates' fields on all members that both files hold
    asked = pairs.select(F.col("prev_id").alias("file_id"), F.col("old_field").alias("field")).unionAll(pairs.select("file_id", F.col("new_field").alias("field"))).distinct()
    values = fields.join(small(asked), ["file_id", "field"], "left_semi").filter(F.col("text").isNotNull() & F.col("gml_id").isNotNull()).groupBy("file_id", "gml_id", "field").agg(F.min_by("text", F.struct("pos", "text")).alias("text"))
    # a file may hold a third of all members: its values don't move for the join if the candidates fit a broadcast
    pairs = small(pairs)
    old = pairs.join(values.select(F.col("file_id").alias("prev_id"), F.col("field").alias("old_field"), "gml_id", F.col("text").alias("old_text")), ["prev_id", "old_field"])
    seen = old.join(values.select("file_id", F.col("field").alias("new_field"), "gml_id", F.col("text").alias("new_text")), ["file_id", "new_field", "gml_id"])
    checked = seen.groupBy("file_id", "old_field", "new_field").agg(F.count("*").alias("n"), F.count_if(F.col("old_text") == F.col("new_text")).alias("agree"))
    renamed = cut(checked.groupBy("file_id").applyInPandas(_match, "file_id long, old_field string, new_field string"))
    out = lambda df, kind, a, b: df.select("file_id", F.lit(kind).alias("change_kind"), a.alias("old_field"), b.alias("new_field"))
    col, none = F.col, F.lit("")
    kinds = pairs.join(renamed, ["file_id", "old_field", "new_field"])
    differ = lambda df: df.filter(F.col("old_kind") != F.col("new_kind"))
    tops = fields.groupBy("file_id", "top").agg(F.count("*").alias("n"))
    return (
        out(renamed, "renamed", col("old_field"), col("new_field"))
        .unionAll(out(gone.join(renamed.select("file_id", "old_field"), ["file_id", "old_field"], "left_anti"), "removed", col("old_field"), none))
        .unionAll(out(new.join(renamed.select("file_id", "new_field"), ["file_id", "new_field"], "left_anti"), "added", none, col("new_field")))
        .unionAll(out(differ(both), "type_changed", col("field"), col("field")))
        .unionAll(out(differ(kinds), "type_changed", col("new_field"), col("new_field")))
        .unionAll(_top_changes(before, tops, out))
    )


def _top_changes(before: DataFrame, tops: DataFrame, out) -> DataFrame:
    """Changes of the field around the members: the keys that went and that came are matched by how common they are."""
    now = before.join(tops, "file_id").select("file_id", "top", F.lit(1).alias("is_new"), F.col("n").alias("new_n"))
    then = before.join(tops.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "top", F.lit(1).alias("is_old"), F.col("n").alias("old_n"))
    both = now.join(then, ["file_id", "top"], "full")
    order = lambda n: W.partitionBy("file_id").orderBy(F.desc(n), "top")
    gone = both.filter(F.col("is_new").isNull()).select("file_id", F.col("top").alias("old_field"), F.row_number().over(order("old_n")).alias("k"))
    new = both.filter(F.col("is_old").isNull()).select("file_id", F.col("top").alias("new_field"), F.row_number().over(order("new_n")).alias("k"))
    pairs = gone.join(new, ["file_id", "k"], "full")
    kind = F.when(F.col("old_field").isNull(), "added").when(F.col("new_field").isNull(), "removed").otherwise("renamed")
    return pairs.select("file_id", kind.alias("change_kind"), F.coalesce("old_field", F.lit("")).alias("old_field"), F.coalesce("new_field", F.lit("")).alias("new_field"))


def canonical_names(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, field, canonical) for every field whose name isn't its canonical one: that under which its series first had it.

    Follows the renames of a series through its files in order; the work per series is its report, not its rows. A new field
    that bears the canonical name of another one that is still there gets a number behind its name.
    """
    order = files.dropna(subset=["file_id", "series_code", "delivery_no"]).dropDuplicates(["file_id"]).select("file_id", "series_code", "delivery_no")
    steps = order.join(changes.filter(F.col("change_kind") != "type_changed"), "file_id", "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        rows = []
        for (_, file_id), step in pdf.sort_values(["delivery_no", "file_id"]).groupby(["delivery_no", "file_id"], sort=True):
            told = list(zip(step["change_kind"], step["old_field"], step["new_field"], strict=True))
            ended = {a for k, a, _ in told if k in ("removed", "renamed")}
            came = {b: names.get(a, a) for k, a, b in told if k == "renamed"}
            names = {f: c for f, c in names.items() if f not in ended} | came
            taken = set(names.values())
            for b in sorted(b for k, _, b in told if k == "added"):
                if b in taken:
                    names[b] = next(c for n in range(2, len(taken) + 3) if (c := f"{b}~{n}") not in taken)
                    taken.add(names[b])
            rows += [(file_id, f, c) for f, c in names.items() if f != c]
        return pd.DataFrame(rows, columns=["file_id", "field", "canonical"]).astype({"file_id": "int64", "field": object, "canonical": object})

    return steps.groupBy("series_code").applyInPandas(follow, "file_id long, field string, canonical string")


def unified_members(members: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """All fields of all readable members: file_id, pos, gml_id, top, field (its first name in the series), kind, text."""
    return _named(member_fields(members, "file_id", "pos", "body"), canonical_names(changes, files))


def _named(fields: DataFrame, names: DataFrame) -> DataFrame:
    return fields.filter(F.col("field").isNotNull()).join(small(names), ["file_id", "field"], "left").select("file_id", "pos", "gml_id", "top", F.coalesce("canonical", "field").alias("field"), "kind", "text")


#: Type of a column by the commonest JSON type of its field; arrays and objects stay JSON text.
COLUMN_TYPES = {"number": "double", "boolean": "boolean"}


def column_types(unified: DataFrame) -> dict[str, str]:
    """Type of each canonical field: that of its commonest JSON type (of equally common ones the first by name)."""
    counts = unified.filter(F.col("kind").isNotNull()).groupBy("field", "kind").agg(F.count("*").alias("n"))
    best = counts.groupBy("field").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind")).orderBy("field").collect()  # one row a field
    return {r["field"]: COLUMN_TYPES.get(r["kind"], "string") for r in best}


def unified_table(members: DataFrame, files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, misfits) of all members.

    table: file_id, pos, readable, top, and a column for each canonical field in one type for all files (null where a member
    doesn't have it; a name that is taken, also in another case, gets ``~`` behind it); a member whose body can't be read has
    readable false. misfits: file_id, pos, field, kind and text of
    the values that don't fit their column's type; they are null in the table. No shuffle: a member's fields are renamed in
    place, by a small map for its file.
    """
    renames = cut(canonical_names(changes, files))
    types = column_types(_named(member_fields(members, "file_id", "pos", "body"), renames))
    names = renames.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "field"))).alias("__field_of"), F.collect_set("field").alias("__renamed"))
    parsed = members.select("file_id", "pos", F.map_entries(F.from_json("body", "map<string,string>")).alias("__tops"))
    first = F.get("__tops", F.lit(0))
    texts = parsed.select("file_id", "pos", F.coalesce(F.size("__tops") > 0, F.lit(False)).alias("readable"), first["key"].alias("top"), F.from_json(first["value"], "map<string,string>").alias("__texts")).join(small(names), "file_id", "left")

    def value(field: str) -> Column:
        own = F.when(~F.coalesce(F.array_contains("__renamed", field), F.lit(False)), F.try_element_at("__texts", F.lit(field)))
        return F.coalesce(F.try_element_at("__texts", F.try_element_at("__field_of", F.lit(field))), own)

    fit = {"string": lambda v: v, "double": lambda v: v.try_cast("double"), "boolean": lambda v: F.when(v == "true", True).when(v == "false", False)}
    typed = {f: fit[t](value(f)) for f, t in types.items()}
    own = ["file_id", "pos", "readable", "top"]
    taken, names_of = set(own), {}
    for f in typed:  # names of columns differ without regard to case
        names_of[f] = next(c for c in (f, f"{f}~", *(f"{f}~{n}" for n in range(2, len(typed) + 3))) if c.lower() not in taken)
        taken.add(names_of[f].lower())
    table = texts.select(*own, *[c.alias(names_of[f]) for f, c in typed.items()])
    bad = [F.when(value(f).isNotNull() & typed[f].isNull(), F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), value(f).alias("text"))) for f, t in types.items() if t != "string"]
    none = F.array().cast("array<struct<field:string,type:string,text:string>>")
    misfits = texts.select("file_id", "pos", F.explode(F.array_compact(F.array(*bad)) if bad else none).alias("m")).select("file_id", "pos", "m.*")
    return table, misfits
