"""Token counts: pieces are counted once per distinct pre-token, joined to per-document frequencies, and summed.

White space never joins a pre-token of the supported vocabularies, so texts are cut at white space, and each distinct
run into its pre-tokens. A first pass gathers the distinct pre-tokens of the whole table, aggregated in the tasks
before they travel, and counts the pieces of each once. A second pass yields, for each document, how often it holds
each pre-token; these rows are joined with the counted table and summed. The join is a broadcast of the most
frequent pre-tokens, up to a checked size, and a shuffle for the rest, which are rare and so never hot. No ids are kept. Texts that hold a special token's string go through the library whole, as do vocabularies whose
pre-tokeniser isn't known to cut at white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, tidied

#: Distinct pre-tokens that a task of the first pass gathers before it hands them on; more only repeat rows.
GATHERED = 1_000_000
#: Counted pre-tokens that are broadcast, in bytes; the rest is joined by shuffle.
HEAD_BYTES = 32 << 20
#: What a broadcast row takes beside its string.
ROW_BYTES = 48


class PieceCounter:
    """Counts tokens of texts with a vocabulary file of the tokenizers (.json) or sentencepiece (.model) library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special: list[str] = []
        self.pattern, self.by_chunk = None, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = [x["content"] for x in added]
        self.by_chunk = _cuts_at_white_space(spec) and not any(x.get("normalized") for x in added)
        self.pattern = _plain_pattern(spec) if self.by_chunk else None

    def whole_only(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library must take whole."""
        if not self.by_chunk:
            return np.ones(len(texts), dtype=bool)
        found = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def pre_tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(text, unit) of each place, by number, and the units.

        A unit is a pre-token, or a run without white space that holds letters whose cuts are left to the library.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        chunk, size, first, units = coded.indices.to_numpy(), *self._cut(coded.dictionary)
        many = size[chunk]
        before = np.cumsum(size) - size
        at = np.repeat(before[chunk] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.repeat(owner, many), first[at], units

    def _cut(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """How many units each chunk has, their numbers one after another, and the units."""
        n = len(chunks)
        if self.pattern is None:
            filled = pc.not_equal(pc.binary_length(chunks), 0)
            return filled.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(int(pc.sum(filled).as_py() or 0)), chunks.filter(filled)
        # Most chunks are a word with marks after it, which is two pre-tokens at most.
        simple = pc.extract_regex(chunks, _SIMPLE)
        word, marks = pc.utf8_lower(pc.struct_field(simple, "word")), pc.struct_field(simple, "marks")
        rest = np.flatnonzero(pc.is_null(simple).to_numpy(zero_copy_only=False))
        owner, strings = [], []
        for column in (word, marks):
            has = np.flatnonzero(pc.fill_null(pc.not_equal(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False))
            owner.append(has), strings.append(column.take(pa.array(has)))
        others: list[str] = []
        owners: list[int] = []
        for i, chunk in zip(rest.tolist(), chunks.take(pa.array(rest)).to_pylist(), strict=True):
            found = self.pattern(chunk.lower()) if _PLAIN(chunk) else [chunk]
            others += found
            owners += [i] * len(found)
        owner.append(np.array(owners, dtype=np.int64)), strings.append(pa.array(others, pa.large_string()))
        at, coded = np.concatenate(owner), pa.concat_arrays([x.cast(pa.large_string()) for x in strings]).dictionary_encode()
        order = np.argsort(at, kind="stable")
        return np.bincount(at, minlength=n), coded.indices.to_numpy()[order], coded.dictionary


#: Printable ASCII and precomposed Latin letters whose lower case is one letter of the same range.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*").fullmatch
#: Fixed value: the pre-token pattern of the lower-casing word vocabulary, and the same over the plain characters.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-zß-öø-ſ0-9]+")
#: A word of plain letters and ASCII marks after it, without the apostrophes that cut pre-tokens.
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ſ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _plain_pattern(spec: dict):
    """The pre-tokens of a plain chunk in lower case, if this is a vocabulary whose steps are known here."""
    first = (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])[0]
    same = (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and first.get("pattern") == {"Regex": _WORDS}
    return _PLAIN_WORDS.findall if same else None


def _cuts_at_white_space(spec: dict) -> bool:
    """Whether no pre-token spans white space: a Split that removes all but runs without white space."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and spec["model"]["type"] == "BPE"


def _strings(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def distinct_pre_tokens(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Rows (unit, uses, pieces): each distinct pre-token of the table, how often it occurs, and its pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path)
        met: list[pa.Table] = []
        held = 0

        def merged() -> pa.Table:
            return pa.concat_tables(met).group_by("unit").aggregate([("uses", "sum")]).rename_columns(["unit", "uses"])

        for batch in slices(batches, text):
            texts = _strings(batch, text)
            _, unit, units = counter.pre_tokens(texts.filter(pa.array(~counter.whole_only(texts))))
            met.append(pa.table({"unit": units.cast(pa.string()), "uses": np.bincount(unit, minlength=len(units))}))
            held += len(units)
            if held > GATHERED:
                met = [merged()]
                held = len(met[0])
                if 2 * held > GATHERED:
                    yield from met[0].to_batches(max_chunksize=100_000)
                    met, held = [], 0
        if met:
            yield from merged().to_batches(max_chunksize=100_000)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path)
        for batch in batches:
            pieces = pa.array(counter.whole(batch.column("unit").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("unit", "uses")), pieces], names=["unit", "uses", "pieces"])

    found = df.select(F.col(f"`{text}`")).mapInArrow(tidied(gather), "unit string, uses long").groupBy("unit").agg(F.sum("uses").alias("uses"))
    return found.mapInArrow(tidied(measure), "unit string, uses long, pieces long")


def _head(counted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pre-tokens to broadcast, whole classes of frequency up to HEAD_BYTES, and the rest (None: there is none)."""
    classes = counted.groupBy(F.floor(F.log2("uses")).cast("int").alias("c")).agg(F.sum(F.octet_length("unit") + ROW_BYTES).alias("size"))
    least, total = None, 0
    sizes = sorted(((r["c"], r["size"]) for r in classes.collect()), reverse=True)  # 64 classes at most
    for c, size in sizes:
        total += size
        if total > HEAD_BYTES:
            break
        least = c
    small = counted.select("unit", "pieces")
    if total <= HEAD_BYTES:
        return small, None
    frequent = F.floor(F.log2("uses")) >= (least if least is not None else 64)
    return small.filter(frequent), small.filter(~frequent)


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """df's rows, without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit) added.

    Columns of these names are replaced. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted
    each. A text of any length is taken whole. An empty table gives an empty result. tokenizer_path must exist on
    every executor.
    """
    bounded_batches(df.sparkSession)
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c not in added and c != text]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("text"))
    by_chunk = PieceCounter(tokenizer_path).by_chunk
    carried = rows.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what is carried, and one for each of its pre-tokens."""
        counter = PieceCounter(tokenizer_path)
        for batch in slices(batches, "text"):
            texts = _strings(batch, "text")
            alone = counter.whole_only(texts)
            direct = np.zeros(batch.num_rows, dtype=np.int64)
            if alone.any():
                direct[alone] = counter.whole(texts.filter(pa.array(alone)).to_pylist())
            row = batch.column("_row").to_numpy()
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row), pc.binary_length(texts), pa.nulls(len(row), pa.string()), pa.array(direct)], names=[*carried, "_row", "_bytes", "unit", "n"])
            if alone.all():
                continue
            doc, unit, units = counter.pre_tokens(texts.filter(pa.array(~alone)))
            key, n = np.unique(doc * max(1, len(units)) + unit, return_counts=True)
            doc, unit, units = row[~alone][key // max(1, len(units))], key % max(1, len(units)), units.cast(pa.string())
            for at in range(0, len(doc), 100_000):
                own = unit[at : at + 100_000]
                nulls = [pa.nulls(len(own), c.type) for c in columns]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(doc[at : at + 100_000]), pa.nulls(len(own), pa.int64()), units.take(pa.array(own)), pa.array(n[at : at + 100_000])], names=[*carried, "_row", "_bytes", "unit", "n"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    held = rows.mapInArrow(tidied(run), (fields + ", " if fields else "") + "_row long, _bytes long, unit string, n long")
    first = [F.first(c, ignorenulls=True).alias(c) for c in carried]
    if by_chunk:
        head, tail = _head(materialise(distinct_pre_tokens(df, tokenizer_path, text), "pre-tokens"))
        joined = held.join(F.broadcast(head), "unit", "left")
        rare = F.when(F.col("pieces").isNull(), F.col("unit"))  # null for all rows if there is no rest
        found = F.when(F.col("unit").isNull(), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
        if tail is None:
            whole = joined.groupBy("_row").agg(*first, F.max("_bytes").alias("_bytes"), F.sum(found).alias("n"))
        else:
            # What the head counts is summed by document; the rest goes on by pre-token, and is rare.
            parts = joined.groupBy("_row", rare.alias("unit")).agg(*first, F.max("_bytes").alias("_bytes"), F.sum(F.when(rare.isNull(), found).otherwise(F.col("n"))).alias("n"))
            parts = materialise(parts, "counted")
            rest = parts.filter("unit is not null").select("unit", "_row", "n").join(tail, "unit").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("_rest"))
            whole = parts.filter("unit is null").join(rest, "_row", "left").withColumn("n", F.col("n") + F.coalesce("_rest", F.lit(0)))
    else:
        whole = held.withColumnRenamed("unit", "_unit")
    return whole.select(*[F.col(c).alias(name) for c, name in zip(carried, kept, strict=True)], F.col("_bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
