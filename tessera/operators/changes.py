"""Change detection: flattening, matching, classification and review of document versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_occurrences(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows paired by key and by how many equal keys came before: MATCHED, ADDED or REMOVED."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.row_number().over(w).alias("o_i"))
    b = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.row_number().over(w).alias("n_i"))
    same = F.col("o_i") == F.col("n_i")
    for k in keys:
        same = same & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    both = a.join(b, same, "full")
    change = F.when(F.col("o_i").isNull(), "ADDED").when(F.col("n_i").isNull(), "REMOVED").otherwise("MATCHED")
    return both.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], F.coalesce("o_i", "n_i").cast("long").alias("i"), change.alias("change"))


def keyed_changes(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """ADDED, REMOVED and MODIFIED values of rows paired by key and by how many equal keys came before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.row_number().over(w).alias("o_i"), F.col(value).alias("old"))
    b = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.row_number().over(w).alias("n_i"), F.col(value).alias("new"))
    same = F.col("o_i") == F.col("n_i")
    for k in keys:
        same = same & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    both = a.join(b, same, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("o_i").isNull(), "ADDED").when(F.col("n_i").isNull(), "REMOVED").otherwise("MODIFIED")
    return both.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], F.coalesce("o_i", "n_i").cast("long").alias("i"), change.alias("change_type"), "old", "new")


def flatten_json(df: DataFrame, key: str, json: str, depth: int = 6) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text, paths as a.b[0]; positional for lists. Objects and lists open one
    level at a time; what lies deeper than depth stays whole as its JSON text. Unreadable JSON gives no rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    rows = rows.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    for i in range(depth):
        # One pass: what is nested opens, leaves stay as they are, so no level is worked out again for the next.
        opened = rows.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("nested"), F.col("v")).outer()).toDF("pos", "key_", "inner")).where("not nested or pos is not null")
        step = F.when(F.col("key_").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key_")).otherwise(F.concat("path", F.lit("."), "key_"))
        rows = opened.select("k", F.when(F.col("nested"), step).otherwise(F.col("path")).alias("path"), F.when(F.col("nested"), F.col("inner")).otherwise(F.col("v")).alias("v"), "nested")
        if i < depth - 1:
            kind = F.schema_of_variant("v")
            rows = rows.withColumn("nested", F.col("nested") & (kind.startswith("OBJECT") | kind.startswith("ARRAY")))
    return rows.select(F.col("k").alias(key), "path", F.to_json("v").alias("value")).where("value <> 'null'")


def one_to_one(asked: DataFrame, given: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, valid): the answers of a key name every asked item exactly once and no other."""
    a = asked.groupBy(key, ident).agg(F.count("*").alias("n"))
    g = given.groupBy(key, ident).agg(F.count("*").alias("m"))
    both = a.join(g, [key, ident], "full")
    return both.groupBy(key).agg(F.bool_and((F.coalesce("n", F.lit(0)) == 1) & (F.coalesce("m", F.lit(0)) == 1)).alias("valid"))


def flatten_paths(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, path, value): one row for each field that has a value; values as JSON text."""
    pairs = [F.struct(F.lit(p).alias("path"), F.to_json(F.array(c)).alias("value")) for p, c in fields.items()]
    rows = df.select(key, F.inline(F.array(*pairs)))
    return rows.where("value <> '[null]' and value <> '[]'").withColumn("value", F.expr("substring(value, 2, length(value) - 2)"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ADDED, REMOVED and MODIFIED paths between two flattened versions."""
    a = old.select(F.col(key).alias("ok"), F.col("path").alias("op"), F.col("value").alias("old"))
    b = new.select(F.col(key).alias("nk"), F.col("path").alias("np"), F.col("value").alias("new"))
    both = a.join(b, (F.col("ok") == F.col("nk")) & (F.col("op") == F.col("np")), "full")
    kind = F.when(F.col("ok").isNull(), "ADDED").when(F.col("nk").isNull(), "REMOVED").otherwise("MODIFIED")
    rows = both.select(F.coalesce("ok", "nk").alias(key), F.coalesce("op", "np").alias("path"), kind.alias("change_type"), "old", "new")
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


# A change whose path has one of these counts as ..., the first that fits.
IMPACTS = {
    "eligibility": ("eligibility_rules",),
    "timeline": ("application_start_date", "application_end_date"),
    "schedule": ("exam_dates",),
}


def impact(path: Column) -> Column:
    first = None
    for name, markers in IMPACTS.items():
        hit = F.lit(False)
        for m in markers:
            hit = hit | path.contains(m)
        first = F.when(hit, name) if first is None else first.when(hit, name)
    return first.otherwise("other")


def impact_rollup(changes: DataFrame, key: str) -> DataFrame:
    """Of every document: which impacts its changes have, and whether it has to be evaluated again."""
    kinds = changes.withColumn("impact", impact(F.col("path")))
    flags = [F.bool_or(F.col("impact") == k).alias(f"{k}_changed") for k in (*IMPACTS, "other")]
    return kinds.groupBy(key).agg(F.count("*").alias("changes"), *flags).withColumn("re_evaluate", F.col("eligibility_changed"))


def hash_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """NO_CHANGE or CHANGE_DETECTED by content hash; a document without an old hash has changed."""
    a = old.select(F.col(key), F.col("hash").alias("old_hash"))
    b = new.select(F.col(key), F.col("hash").alias("new_hash"))
    return b.join(a, key, "left").withColumn("status", F.when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "NO_CHANGE").otherwise("CHANGE_DETECTED"))


def transition(rows: DataFrame, requests: DataFrame, key: str, status: str, allowed: list[tuple[str, str, str]], order: str | None = None, needs: dict[str, str] | None = None, guard: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new rows, refused requests): each request (key, action) moves a row along the allowed (from, action, to) steps.

    Of several allowed requests for a key the first (by order, then action) is taken: the row has left their state, so the
    others are refused, as are requests without a text in the column that their action needs, and those whose guard column
    (what the request saw) is no longer what the row's guard column has."""
    steps = rows.sparkSession.createDataFrame(allowed, "_from string, _action string, _to string")
    seen = guard[1] if guard else None
    state = rows.select(F.col(key).alias("_key"), F.col(status).alias("_status"), *([F.col(seen).alias("_seen")] if seen else []))
    asked = requests.join(state, F.col(key) == F.col("_key"), "left").join(F.broadcast(steps), (F.col("_status") == F.col("_from")) & (F.col("action") == F.col("_action")), "left")  # steps: the caller's list
    fits = F.col("_to").isNotNull()
    for action, column in (needs or {}).items():
        fits = fits & ((F.col("action") != action) | (F.coalesce(F.trim(column), F.lit("")) != ""))
    if guard:
        fits = fits & F.col(guard[0]).eqNullSafe(F.col("_seen"))
    place = F.struct(*([order] if order else []), "action", "_to")
    ranked = asked.withColumn("_fits", fits).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_fits"), place)))
    ranked = ranked.withColumn("_taken", F.col("_fits") & (F.col("_rank") == 1))
    moved = ranked.where("_taken").select(key, F.col("_to"))
    out = rows.join(moved, key, "left").withColumn(status, F.coalesce("_to", status)).drop("_to")
    return out, ranked.where("not _taken").select(requests.columns)


def listed_reviews(reviews: DataFrame, parents: DataFrame, key: str, report: str, status: str, only: str | None = None) -> DataFrame:
    """Reviews beside their parents' columns, with the number of changes and the summary that their report (JSON) holds, null
    where it is no such JSON; only those of one status where it is given."""
    rows = reviews if only is None else reviews.where(F.col(status) == only)
    held = F.when(F.try_parse_json(report).isNotNull(), F.col(report))
    return rows.join(parents, key).withColumns({"n_changes": F.json_array_length(F.get_json_object(held, "$.changes")), "summary": F.get_json_object(held, "$.summary")})
