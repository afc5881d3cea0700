"""Names of many words and of any number in running text, found by a join; the evidence of where a listing lies.

A dictionary of phrases is keyed by its words. At each place of a text only the lengths that phrases with its first word
have are tried, and each try meets the phrase of just these words, so a text costs its words, whatever the dictionary's
size and however many phrases begin alike, and no pattern of all names is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from . import gates as G
from .staging import stage


def words_of(c: Column) -> Column:
    """Lower-case words of letters and digits; & is a word."""
    return F.filter(F.split(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" & ")), "[^a-z0-9&]+", " "), " "), lambda w: w != "")


def phrase_table(phrases: DataFrame) -> DataFrame:
    """gram, first, n (the words of a phrase, the first of them and their number) and the columns but `phrase`, from phrases (phrase, ...).

    Phrases without a word are left out; of equal rows one stays. It is written once, so that what is joined with it is
    planned by its true size.
    """
    others = [c for c in phrases.columns if c != "phrase"]
    rows = phrases.select(words_of(F.col("phrase")).alias("words"), *others).filter(F.size("words") > 0)
    return stage(rows.select(F.array_join("words", " ").alias("gram"), F.get("words", F.lit(0)).alias("first"), F.size("words").alias("n"), *others).distinct(), "phrases")


def find_phrases(texts: DataFrame, table: DataFrame, most: int, longest: bool = False) -> DataFrame:
    """Occurrences of phrases (a phrase_table() of phrases of up to `most` words) in texts (id, text): id, start (from 0), n
    and the table's columns. With `longest`, at each place of an id only the longest phrases count.
    """
    table = table.filter(F.col("n") <= most)
    lengths = table.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    # each word beside those after it, as arrays moved by one: no place copies or walks its whole text
    names = [f"w{k}" for k in range(most)]
    texts = texts.select("id", words_of(F.col("text")).alias("w0"))
    texts = texts.select("id", "w0", *[F.slice("w0", F.lit(k + 1), F.size("w0")).alias(names[k]) for k in range(1, most)])
    placed = texts.select("id", F.posexplode(F.arrays_zip(*names)).alias("start", "at")).select("id", "start", *[F.col("at")[w].alias(w) for w in names])
    tried = placed.withColumnRenamed("w0", "first").join(lengths, "first").withColumn("n", F.explode("lengths"))
    ahead = F.slice(F.array("first", *names[1:]), F.lit(1), F.col("n"))
    grams = tried.select("id", "start", ahead.alias("ahead")).filter(F.element_at("ahead", -1).isNotNull()).select("id", "start", F.array_join("ahead", " ").alias("gram"))
    found = grams.join(table.drop("first"), "gram").drop("gram")
    if longest:
        found = found.withColumn("longest", F.max("n").over(Window.partitionBy("id", "start"))).filter("n = longest").drop("longest")
    return found.select("id", "start", "n", *[c for c in table.columns if c not in ("gram", "first", "n")])


def place_names(spark) -> DataFrame:
    """phrase, name, kind (here, ambiguous or elsewhere) and rank (the order in which names are told) of the places that decide."""
    unsure = {x.lower() for x in G.AMBIGUOUS}
    key = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    here = [(x, key(x), "here") for x in dict.fromkeys(G.DISTRICTS + G.CITIES) if x.lower() not in unsure]
    rows = here + [(x, key(x), "ambiguous") for x in G.AMBIGUOUS] + [(x, x, "elsewhere") for x in G.OTHER_STATES]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "phrase string, name string, kind string, rank int")


def location_evidence(rows: DataFrame) -> DataFrame:
    """id, verdict, basis and reasons: is a property (id, state, district, city, area, address, pin) in the state, and why.

    basis lists the evidence for it, reasons what speaks against it or is missing; see gates.location_verdict for the
    rules. The names of places and states are found by a join with place_names().
    """
    spark = rows.sparkSession
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    text = F.concat_ws(" ", *[F.when(given(c).isNotNull(), F.col(c)) for c in ("address", "area", "city", "district")])
    in_text = F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?i)pin\s*code\s*[-:]?\s*(\d{3}\s?\d{3})\b", 1), r"\s", ""), F.lit(""))
    parts = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), "[,/]") for c in ("district", "city", "area")]))
    keys = F.filter(F.transform(parts, G.place_key), lambda k: k != "")
    read = rows.select(
        "id", given("state").alias("state"), N.canon_state(given("state")).alias("named"), text.alias("text"), F.coalesce(given("pin"), in_text).alias("pin"), keys.alias("keys"),
        (F.coalesce(*[given(c) for c in ("district", "city", "area")]).isNotNull() | (text != "")).alias("any"),
    )
    names = place_names(spark)
    hits = find_phrases(read.select("id", "text"), phrase_table(names.filter("kind <> 'ambiguous'")), 5)
    # a state is named only where white space alone is between its words
    stated = F.expr(r"regexp_like(text, concat('(?i)\\b', replace(name, ' ', '\\s+'), '\\b'))")
    hits = hits.join(read.select("id", "text"), "id").filter((F.col("kind") == "here") | stated).select("id", "kind", "name", "rank").distinct()
    ranked = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "name")))), lambda x: x["name"])
    told = hits.groupBy("id").agg(ranked("here").alias("here"), ranked("elsewhere").alias("elsewhere"))
    fields = read.select("id", F.posexplode("keys").alias("pos", "key")).join(names.filter("kind <> 'elsewhere'").select(F.col("name").alias("key"), "kind"), "key")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("key")), F.when(F.col("kind") == kind, F.col("pos")))
    fields = fields.groupBy("id").agg(first("here").alias("place"), first("ambiguous").alias("unsure"))
    r = read.join(told, "id", "left").join(fields, "id", "left")

    none = F.array().cast("array<string>")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    listed = lambda *items: F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), what) for holds, what in items]))
    own = F.col("named") == G.STATE
    in_name = F.col("text").rlike(rf"(?i)\b{G.STATE}\b")
    pin_ok = G.pin_in_state(F.col("pin"))
    place = F.coalesce("place", F.get("here", F.lit(0)))
    others = F.coalesce("elsewhere", none)
    facts = r.select("id", "state", "named", "pin", "unsure", "any", F.coalesce(own, F.lit(False)).alias("own"), in_name.alias("in_name"), pin_ok.alias("pin_ok"), place.alias("place"), others.alias("others"))
    c = F.col
    basis = listed(
        (c("own"), F.lit(f"state field says {G.STATE}")), (c("in_name"), F.lit(f"address text names {G.STATE}")), (c("pin_ok"), say("PIN ", c("pin"), f" is a {G.STATE} PIN")),
        (c("place").isNotNull(), say('district / city "', c("place"), f'" is in {G.STATE}')),
    )
    for_it = c("own") | c("in_name") | c("place").isNotNull()
    wrong_pin, other = F.coalesce(~c("pin_ok"), F.lit(False)), F.size("others") > 0
    conflicts = listed((wrong_pin & for_it, say("PIN ", c("pin"), f" is not a {G.STATE} PIN but other evidence says {G.STATE}")), (other & for_it, say("the address also names ", F.array_join("others", ", "))))
    missing = F.when(c("any"), f"the location text does not name a {G.STATE} district, city or state, and there is no state field or PIN code").otherwise("no location evidence")
    rules = [
        (c("named").isNotNull() & (c("named") != G.STATE), "reject", none, F.array(say('the property\'s state is "', c("state"), '"'))),
        (F.size(conflicts) > 0, "review", basis, conflicts),
        (wrong_pin, "reject", basis, F.array(say("PIN ", c("pin"), f" is not a {G.STATE} PIN"))),
        (other, "reject", basis, F.array(say("the address names ", F.array_join("others", ", "), f" and not {G.STATE}"))),
        (for_it, "accept", basis, none),
        (c("unsure").isNotNull() & c("pin_ok"), "accept", F.concat(basis, F.array(say('"', c("unsure"), '" is ambiguous but the PIN settles it'))), none),
        (c("unsure").isNotNull(), "review", basis, F.array(say('"', c("unsure"), '" exists in more than one state and no state or PIN settles it'))),
        (F.lit(True), "review", basis, F.array(missing)),
    ]
    out = F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(v).alias("verdict"), b.alias("basis"), why.alias("reasons"))) for holds, v, b, why in rules])
    return facts.select("id", out.alias("o")).select("id", "o.*")
