"""Data that a page's scripts carry: chunks of escaped text put together, and objects found in their JSON at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Fixed value: a script's call that pushes one chunk, a JSON string.
PUSH = r'self\.__next_f\.push\(\[1,("(?:[^"\\]++|\\.)*+")\]\)'
ROW = r"(?s)^[0-9a-f]*:"


def pushed_chunks(html: Column) -> Column:
    """The chunks that a page's scripts push, unescaped, in order; one that is no JSON string is left out."""
    literals = F.regexp_extract_all(html, F.lit(PUSH), F.lit(1))
    return F.array_compact(F.transform(literals, lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))))


def is_container(text: Column) -> Column:
    """Whether a text is one whole JSON object or array and nothing else; the parser by itself passes over what follows a value."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    only = F.try_variant_get(one, "$[1]", "variant").isNull()
    return text.rlike(r"^\s*[\[{]") & one.isNotNull() & only & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def payload_rows(chunks: Column) -> Column:
    """The rows "id:value" of the chunks, as the JSON texts of their values.

    A chunk whose value is a whole object or array is a row by itself. Chunks between such ones are parts: they are
    joined in order, and a new row starts at each line that has an id. Other values are left out.
    """
    told = F.transform(chunks, lambda c: F.struct(c.alias("text"), is_container(F.regexp_replace(c, ROW, "")).alias("whole")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, c: Column) -> Column:
        closed = F.when(acc["held"].isNotNull(), F.array_append(acc["done"], acc["held"])).otherwise(acc["done"])
        held = F.when(~c["whole"], F.concat(F.coalesce(acc["held"], F.lit("")), c["text"]))
        return F.struct(F.when(c["whole"], F.array_append(closed, c["text"])).otherwise(acc["done"]).alias("done"), held.alias("held"))

    joined = F.aggregate(told, start, step, lambda acc: F.when(acc["held"].isNotNull(), F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]))
    rows = F.flatten(F.transform(joined, lambda t: F.split(t, r"\n(?=[0-9a-f]+:)")))
    values = F.transform(rows, lambda r: F.regexp_replace(r, ROW, ""))
    return F.filter(values, is_container)


def objects_with(rows: DataFrame, key: str, most: int = 500) -> DataFrame:
    """path and object beside the other columns of rows (json): every object with the given key, at any depth of a JSON text.

    The trees are walked level by level: each round opens the objects and arrays of the level before, of those only that
    have the key somewhere inside. Rounds end when none is left, after as many as the deepest tree has levels; a text of
    more than `most` levels is an error. Text that is no JSON has no objects. Objects inside found ones are found too.
    """
    named = f'"{key}":'
    holds = lambda v: F.contains(F.to_json(v), F.lit(named))
    others = [c for c in rows.columns if c != "json"]
    level = rows.select(*others, F.lit("$").alias("path"), F.try_parse_json("json").alias("node")).filter(holds(F.col("node")))
    found = None
    for _ in range(most):
        level = stage(level, "level")
        if level.isEmpty():
            return found if found is not None else level.withColumnRenamed("node", "object")
        own = F.expr(f"try_variant_get(node, '$[\"{key}\"]', 'variant')")
        here = level.filter(own.isNotNull()).withColumnRenamed("node", "object")
        found = here if found is None else found.unionByName(here)
        level.createOrReplaceTempView("_level")
        opened = level.sparkSession.sql("SELECT l.*, c.pos AS _pos, c.key AS _key, c.value AS _value FROM _level l, LATERAL variant_explode(l.node) c")
        step = F.coalesce(F.concat(F.lit("."), "_key"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = opened.filter(holds(F.col("_value"))).select(*others, F.concat("path", step).alias("path"), F.col("_value").alias("node"))
    raise ValueError(f"JSON of more than {most} levels")


def embedded_records(pages: DataFrame, key: str, index: str, fields: dict[str, str]) -> DataFrame:
    """The records that pages (page_id, html) embed: `fields` (name to JSON path) of the _source of each item of <key>.data.

    Items of another index or without a _source are left out. A record that a page embeds more than once is one row.
    """
    texts = pages.select("page_id", F.explode(payload_rows(pushed_chunks(F.coalesce("html", F.lit(""))))).alias("json"))
    found = objects_with(texts, key)
    items = F.expr(f"try_variant_get(object, '$.{key}.data', 'array<variant>')")
    rows = found.select("page_id", F.explode(items).alias("item")).filter(F.expr("try_variant_get(item, '$._index', 'string')") == index)
    source = rows.select("page_id", F.expr("try_variant_get(item, '$._source', 'variant')").alias("source"))
    return source.filter("source IS NOT NULL").select("page_id", *[F.expr(f"try_variant_get(source, '{path}', 'string')").alias(name) for name, path in fields.items()]).distinct()
