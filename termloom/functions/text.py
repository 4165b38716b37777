"""Text analysis as column expressions: tokenizers, filters and their chains."""

import re
import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.functions.porter import stem

#: Token patterns of the two regex tokenizers, matched without regard to ASCII case.
PATTERNS = {
    "alphanum": r"(?i)([a-z0-9]+)",
    "symbol": r"(?i)([a-z0-9]+(?:[+#&.\-]+[a-z0-9]*)*|[!])",
}

#: The usual English stop set of full-text indexes.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

#: The stop words that the relevance model leaves out, in alphabetical order.
MODEL_STOP = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "did", "do", "does", "doing", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i",
    "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "s", "same", "she", "should", "so",
    "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
)

SYMBOLS = r"[+#&.\-]"


def letters(test) -> str:
    """The code points that pass a test, as the inside of a character class."""
    found = [c for c in range(sys.maxunicode + 1) if test(chr(c))]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(found), lambda x: x[1] - x[0])]
    return "".join(f"\\x{{{r[0]:x}}}" + (f"-\\x{{{r[-1]:x}}}" if len(r) > 1 else "") for r in runs)


#: White space and digits of any script, by Python's tables.
SPACE, DIGIT = letters(str.isspace), letters(str.isdigit)


def tokens(text: Column, mode: str = "alphanum") -> Column:
    """Lower-case tokens of a text in order; null and empty texts have none."""
    if mode not in PATTERNS:
        raise ValueError(f"unknown tokenizer mode {mode!r}; one of {sorted(PATTERNS)}")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[mode]))
    return F.transform(found, F.lower)


#: What each byte of a text is to the "alphanum" tokenizer: itself in lower case, or 0 between tokens.
ALPHANUM = np.array([ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 0 for b in range(256)], np.uint8)

#: Bytes of text that are split in numpy at once, on average: few enough that its arrays stay in a core's cache.
PIECE = 400_000


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with some PIECE bytes of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECE)) + 1
    return zip(np.append(0, cuts).tolist(), np.append(cuts, len(sizes)).tolist())


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each row begins, with the end; null counts as empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def counted_tokens(texts: pa.Array, wanted: Callable | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """row, term, tf: how often each text holds each token of `tokens`, mode "alphanum".

    wanted: which of an array of terms to give; a row without a term has the number of all tokens of its text then.
    """
    data, begins = bytes_of(texts)
    low = ALPHANUM[data]
    held = low != 0
    first = held.copy()
    first[1:] &= ~held[:-1]
    first[(at := begins[:-1])[at < len(low)]] |= held[at[at < len(low)]]  # a token ends where its text does
    rows = np.searchsorted(begins, np.flatnonzero(first), "right") - 1
    offsets = np.append(np.flatnonzero(first[held]), np.count_nonzero(held)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(low[held])).dictionary_encode()
    n, codes = max(1, len(words.dictionary)), words.indices.to_numpy()
    lengths = np.bincount(rows, minlength=len(texts)) if wanted else np.zeros(0, np.int64)
    if wanted:
        listed = wanted(words.dictionary)[codes]
        rows, codes = rows[listed], codes[listed]
    keys, tf = np.unique(rows * n + codes, return_counts=True)
    whole = np.flatnonzero(lengths)
    terms = pa.concat_arrays([words.dictionary.take(pa.array(keys % n)), pa.nulls(len(whole), pa.string())])
    return np.append(keys // n, whole), terms, np.append(tf, lengths[whole])


def count_alphanum(docid: pa.DataType, wanted: Callable | None = None):
    """A function of Arrow batches docid, text that gives docid, term, tf of `counted_tokens`."""
    schema = pa.schema([("docid", docid), ("term", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in pieces(batch["text"]):
                part = batch.slice(a, z - a)
                rows, terms, tf = counted_tokens(part["text"], wanted)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([part["docid"].take(pa.array(rows)), terms, pa.array(tf)], schema=schema)

    return run


def without(words: Column, stop: tuple[str, ...]) -> Column:
    """words that aren't in stop, duplicates kept."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: ~F.array_contains(listed, w))


def trim_apostrophes(words: Column) -> Column:
    """Trailing straight and curly apostrophes off each word; words of nothing else go."""
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "['’‘]+$", "")), lambda w: w != "")


def whitespace_tokens(text: Column, lower: bool = True, digits: bool = True) -> Column:
    """Words between white space of any script, in lower case; without `digits`, words of digits alone go."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text) if lower else text, f"[{SPACE}]+"), lambda w: w != "")
    return words if digits else F.filter(words, lambda w: ~w.rlike(f"^[{DIGIT}]+$"))


def join_tokens(words: Column) -> Column:
    return F.array_join(words, " ")


def title_and_body(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def strip(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def analyze(rows: DataFrame, key: str, text: str, mode: str = "symbol", stem: bool = True) -> DataFrame:
    """key, tokens through the whole chain: lower, apostrophes, stop words, stems, apostrophes.

    Words that hold a symbol are exempt from stemming. mode "english" takes words and inner apostrophes as its pattern, strips
    possessives and stems every word. Words are stemmed in place, each distinct one of a batch once, so none is shuffled.
    """
    if mode == "english":
        found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("([\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*)")), F.lower)
        words = F.transform(found, lambda w: F.regexp_replace(w, "['’]s$", ""))
    else:
        words = tokens(F.col(text), mode)
    rows = rows.select(key, without(trim_apostrophes(words), STOP).alias("tokens"))
    if not stem:
        return rows
    stem_all = in_place(None if mode == "english" else re.compile(SYMBOLS))
    return rows.mapInArrow(stem_all, rows.schema).select(key, trim_apostrophes(F.col("tokens")).alias("tokens"))


def in_place(exempt: re.Pattern | None, most: int = 500_000):
    """A function of Arrow batches that stems the words of column tokens, but those that `exempt` finds; a worker keeps up to `most` stems."""

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            lists = batch.column(at)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(known) > most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = w if exempt and exempt.search(w) else stem(w)
            stemmed_words = pa.array([known[w] for w in words], pa.string()).take(coded.indices)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield batch.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(offsets, stemmed_words).cast(batch.schema.field(at).type))

    return run


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stems(words: DataFrame) -> DataFrame:
    """word, stem of a table of distinct words (column word)."""
    return words.select("word", stemmed("word").alias("stem"))
