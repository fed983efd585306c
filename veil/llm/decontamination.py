"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, punctuation and case go, and every run of eight tokens is a
template window. Windows of the documents are hash-joined with those of the benchmark items. Where enough of an
item's windows meet in a document, the slots are compared: an item's value must stand for the same document value
throughout one copy, so a question with other numbers and names is caught and a chance meeting of templates is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, scratch

WINDOW = 8
#: A window must hold at least this many words that are no placeholders.
LITERALS = 4
#: An item is met by six windows (thirteen tokens) or half of its windows, whichever is less.
ENOUGH = 6

#: Groups repeat possessively: Java's matcher takes such a loop step by step, where it would recurse for each round of
#: a greedy one, and a line of many names or a long chain of numbers would overflow the stack. Nothing follows the
#: loops, so both match the same.
#: A name is a run of capitalised words (not all capitals) that doesn't begin a sentence or a line.
NAME = r"([^\x20\x09-\x0D.!?:;][\x20\x09]+)(\p{Lu}\p{Ll}[\p{Ll}'’-]*(?:[\x20\x09]+\p{Lu}\p{Ll}[\p{Ll}'’-]*)*+)"
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
UNIT = r"(<num>)[\x20\x09]*(%|‰|°[CFK]?|€|\$|£|km/h|mph|km|cm|mm|kg|mg|ml|kw|kwh|mb|gb|tb|hz|min|hours?|days?|weeks?|months?|years?|miles?|metres?|meters?|grams?|litres?|liters?|dollars?|euros?|pounds?|percent|seconds?|minutes?|m|g|l|s|h)([^\p{L}\p{N}]|$)"
OTHER = r"[^\p{L}\p{M}\p{N}<>]+"
PLACEHOLDERS = ("<name>", "<num>", "<unit>")


def _named(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "<>", "  "), NAME, "$1 <name> ")


def _numbered(text: Column) -> Column:
    return F.regexp_replace(_named(text), NUMBER, " <num> ")


def with_tokens(df: DataFrame, text: str, tokens: str) -> DataFrame:
    """df with the tokens of a text, placeholders included; null and token-free texts have none.

    Each step is a projection of its own that the next one uses more than once, so that the optimiser neither
    merges them nor repeats the replacements.
    """
    marked = F.lower(F.regexp_replace(_numbered(F.col(text)), UNIT, "$1 <unit> $3"))
    spaced = F.trim(F.regexp_replace(marked, OTHER, " "))  # single spaces only
    out = df.withColumn(tokens, F.coalesce(spaced, F.lit("")))
    return out.withColumn(tokens, F.when(F.length(tokens) > 0, F.split(tokens, " ")).otherwise(F.array().cast("array<string>")))


def slots(text: Column) -> Column:
    """The values of each placeholder kind, in their order in the text, lower-cased."""
    low = lambda values: F.transform(values, F.lower)
    return F.array(
        low(F.regexp_extract_all(F.translate(text, "<>", "  "), F.lit(NAME), F.lit(2))),
        low(F.regexp_extract_all(_named(text), F.lit(NUMBER), F.lit(0))),
        low(F.regexp_extract_all(_numbered(text), F.lit(UNIT), F.lit(2))),
    )


def _hashes(tokens: Column, n: Column | int = WINDOW) -> Column:
    """A hash for each window of n tokens; texts shorter than a window have none."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.xxhash64(F.slice(tokens, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _plain(text: Column) -> Column:
    """The words and numbers of a text, lower-cased and without placeholders."""
    spaced = F.trim(F.regexp_replace(F.lower(F.translate(text, "<>", "  ")), OTHER, " "))
    return F.when(F.length(spaced) > 0, F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def _lengths(items: DataFrame, n: str) -> list[int]:
    """The distinct lengths of items that are searched whole: one number each."""
    return sorted(r[0] for r in items.select(n).distinct().collect())


def _verbatim(rows: DataFrame, short: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id) of documents that hold all words and numbers of a short item in a row, as they are."""
    wanted = materialise(short.select("item_id", F.array_join("plain", " ").alias("run"), F.size("plain").alias("n")).filter("n > 0").distinct(), "short-items")
    lengths = _lengths(wanted, "n")
    if not lengths:
        return wanted.select(F.lit(None).cast("long").alias("doc_id"), "item_id")
    size = wanted.agg(F.count("*"), F.sum(F.length("run") + 32)).first()
    index = broadcast_if_small(wanted, size[0], -(-size[1] // size[0])).select("item_id", "run")
    each = rows.withColumn("plain", _plain(F.col("text"))).select("doc_id", "plain", F.explode(F.lit(lengths)).alias("n")).filter(F.size("plain") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("plain") - F.col("n") + 1), lambda i: F.array_join(F.slice("plain", i, F.col("n")), " "))
    return each.select("doc_id", F.explode(F.array_distinct(runs)).alias("run")).join(index, "run").select("doc_id", "item_id").distinct()


def _slot_values(tokens: Column, values: Column, start: Column, n: Column) -> Column:
    """kind:value of each placeholder in the window of n tokens that starts at the 0-based token."""
    window = F.slice(tokens, start + 1, n)
    before = F.slice(tokens, F.lit(1), start)

    def of(kind: int) -> Column:
        mark = PLACEHOLDERS[kind]
        skipped = F.size(F.filter(before, lambda t: t == mark))
        here = F.size(F.filter(window, lambda t: t == mark))
        return F.transform(F.slice(values[kind], skipped + 1, here), lambda v: F.concat(F.lit(f"{kind}:"), v))

    return F.concat(of(0), of(1), of(2))


def _judged(placed: DataFrame, pair: list[str], enough: Column) -> DataFrame:
    """Pairs with enough windows whose slots are consistent: over all hits, or else along one alignment.

    An alignment is an offset between document and item, or a run of hits that go forward in both with small gaps.
    A pair that isn't consistent as a whole is judged by each of them, so that values of one copy don't contradict
    those of another. Windows without slots contradict nothing and always count.
    """
    order = Window.partitionBy(*pair).orderBy("pos", "k")
    breaks = (F.col("k") <= F.lag("k").over(order)) | (F.col("pos") - F.lag("pos").over(order) > 2 * WINDOW)
    numbered = placed.withColumn("breaks", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alignments = [("all", F.lit(0)), ("offset", F.col("pos") - F.col("k")), ("run", F.col("run"))]
    each = numbered.withColumn("alignment", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at")) for kind, at in alignments])))
    maps = F.array_distinct(F.flatten(F.collect_set("slots")))
    summed = each.groupBy(*pair, "windows", "alignment").agg(maps.alias("slots"), F.countDistinct("h").alias("met"), F.countDistinct(F.when(F.size("slots") == 0, F.col("h"))).alias("plain"))
    summed = summed.withColumn("consistent", F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots")).withColumn("changed", F.exists("slots", lambda p: p["i"] != p["d"]))
    whole = F.col("alignment.kind") == "all"
    part = F.struct((F.col("met") - F.col("plain")).alias("slotted"), (~F.col("changed")).alias("same"))
    by_pair = summed.groupBy(*pair, "windows").agg(
        F.max(F.when(whole, F.struct("plain", F.when(F.col("consistent"), F.col("met")).otherwise(F.col("plain")).alias("matched"), "changed"))).alias("w"),
        F.max(F.when(~whole & F.col("consistent"), part)).alias("p"),
    )
    along = F.col("w.plain") + F.col("p.slotted")
    held = F.col("w.matched") >= enough
    return by_pair.select(*pair, "windows", F.when(held, F.col("w.matched")).otherwise(along).alias("matched"), F.when(held, F.col("w.changed")).otherwise(~F.col("p.same")).alias("changed")).filter(F.col("matched") >= enough)


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, matched, windows, changed): items that a document holds, by template.

    matched: how many of the item's windows meet with consistent slots; windows: how many usable ones it has;
    changed: whether slot values differ from the item's. An item without a usable window (fewer tokens than a
    window, or too few literal words in each) is searched whole, as one window of its own length: word for word,
    and by template if it has LITERALS literal words in all. Null and empty texts, and items without any word or
    number, match nothing. Repeated rows of an id count as one
    text each and yield one row; rows without an id are left out. Whole texts are searched; empty tables give an
    empty result.
    """
    item = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("item_id is not null and text is not null")
    item = with_tokens(item, "text", "item_tokens").select("item_id", F.xxhash64("text").alias("item_row"), "item_tokens", slots(F.col("text")).alias("item_slots"), _plain(F.col("text")).alias("plain"))
    literals = lambda tokens: F.size(F.filter(tokens, lambda t: ~t.isin(*PLACEHOLDERS)))
    places = F.when(F.size("item_tokens") >= WINDOW, F.sequence(F.lit(0), F.size("item_tokens") - WINDOW)).otherwise(F.array().cast("array<int>"))
    usable_at = F.exists(places, lambda k: literals(F.slice("item_tokens", k + 1, WINDOW)) >= LITERALS)
    item = item.dropDuplicates(["item_id", "item_row"]).withColumn("n", F.when(usable_at, F.lit(WINDOW)).otherwise(F.size("item_tokens"))).withColumn("short", ~usable_at)
    item = materialise(item, "items")
    whole = F.col("short") & (literals(F.col("item_tokens")) >= LITERALS)
    windows = item.filter(~F.col("short") | whole).select("item_id", "item_row", "item_tokens", "n", F.posexplode(_hashes(F.col("item_tokens"), F.col("n"))).alias("k", "h"))
    windows = materialise(windows.filter(literals(F.slice("item_tokens", F.col("k") + 1, F.col("n"))) >= LITERALS).select("item_id", "item_row", "k", "h"), "item-windows")
    lengths = _lengths(item.filter(whole & (F.col("n") != WINDOW)), "n")
    short = item.filter("short")
    index = broadcast_if_small(windows, windows.count(), 40)
    usable = windows.groupBy("item_id", "item_row").agg(F.countDistinct("h").alias("windows"))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null and text is not null")
    found = with_tokens(rows, "text", "tokens").select("doc_id", F.xxhash64("text").alias("doc_row"), F.posexplode(_hashes(F.col("tokens"))).alias("pos", "h"))
    if lengths:
        longer = with_tokens(rows, "text", "tokens").select("doc_id", F.xxhash64("text").alias("doc_row"), "tokens", F.explode(F.lit(lengths)).alias("n"))
        found = found.unionByName(longer.select("doc_id", "doc_row", F.posexplode(_hashes(F.col("tokens"), F.col("n"))).alias("pos", "h")))
    hits = materialise(found.join(index, "h").select("doc_id", "doc_row", "pos", "h", "item_id", "item_row", "k"), "template-hits")
    pair = ["doc_id", "doc_row", "item_id", "item_row"]
    enough = F.least(F.lit(ENOUGH), F.ceil(F.col("windows") / 2))
    counts = hits.groupBy(*pair).agg(F.countDistinct("h").alias("met")).join(F.broadcast(usable) if index is not windows else usable, ["item_id", "item_row"])
    likely = materialise(counts.filter(F.col("met") >= enough).select(*pair, "windows"), "template-pairs")

    # Slots of the few documents that hold enough windows; one row a pair and place.
    own = likely.select("doc_id", "doc_row").distinct()
    own = broadcast_if_small(own, own.count(), 32, 16 << 20)
    texts = rows.withColumn("doc_row", F.xxhash64("text")).join(own, ["doc_id", "doc_row"]).dropDuplicates(["doc_id", "doc_row"])
    texts = with_tokens(texts, "text", "tokens").select("doc_id", "doc_row", "tokens", slots(F.col("text")).alias("values"))
    placed = hits.join(likely, pair).join(texts, ["doc_id", "doc_row"]).join(item.drop("plain", "short"), ["item_id", "item_row"])
    placed = placed.filter(F.slice("tokens", F.col("pos") + 1, F.col("n")) == F.slice("item_tokens", F.col("k") + 1, F.col("n")))
    pairs = F.arrays_zip(_slot_values(F.col("item_tokens"), F.col("item_slots"), F.col("k"), F.col("n")).alias("i"), _slot_values(F.col("tokens"), F.col("values"), F.col("pos"), F.col("n")).alias("d"))
    placed = placed.select(*pair, "windows", "h", "pos", "k", F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))).alias("slots"))
    judged = _judged(placed, pair, enough).select("doc_id", "item_id", "windows", "matched", "changed")
    judged = judged.withColumn("verbatim", F.lit(False))
    if not short.isEmpty():
        one = F.lit(1).cast("long")
        judged = judged.unionByName(_verbatim(rows, short).select("doc_id", "item_id", one.alias("windows"), one.alias("matched"), F.lit(False).alias("changed"), F.lit(True).alias("verbatim")))
    best = F.max(F.struct("matched", "windows", "verbatim", "changed")).alias("b")
    return judged.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.windows").alias("windows"), F.col("b.changed").alias("changed"))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; rows without an id stay."""
    with scratch(docs.sparkSession) as keep:
        held = keep(materialise(matches(docs, items, doc_id, text).select(F.col("doc_id").alias("_held")).distinct(), "contaminated"))
    held = broadcast_if_small(held, held.count(), 16, 32 << 20)
    return docs.join(held, F.col(f"`{doc_id}`").cast("long") == F.col("_held"), "left_anti")
