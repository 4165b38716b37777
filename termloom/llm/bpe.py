"""BPE encoding and decoding with a tokenizers vocabulary file, by tree concatenation of long text.

A text over `leaf` characters is halved, wherever that falls, down to leaves; the leaves are encoded on their own and neighbours are
concatenated in a tree. At each join a window around it is encoded anew and grown until it begins and ends at white space, its first
piece agrees with the left side's and its last with the right side's; what lies between them comes from the window, the rest from the
sides. Inside a leaf, text is cut at white space into pieces that no token crosses, and pieces are encoded once per worker and then looked up.

A piece over `leaf` characters has no place to cut ("unsplit text"): it's halved too, and a join's window grows until it shares a token with
the left side and one with the right side, start and end alike. In a byte-pair encoding a sequence of tokens is the encoding of its
text if every two neighbours are, so the joined sequence is exact. Where such a piece is longer than `part`, its leaves are rows of their own.

Ids are decoded by the library, piece by piece; without a decoder, which is the only supported case, the library puts a space between any two
tokens, so the pieces' texts are joined by spaces. A vocabulary file with other settings than those these rules hold for is refused.

Defined results: null and empty texts have no tokens; literal special tokens in a text get their ids, as in the library; repeated
rows get equal rows; an empty table gives an empty result. Columns besides doc_id and text are kept apart and ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.shared import WORD, lean, materialize, table

#: Letters of ASCII and Latin-1, which are composed already and lower to one letter each.
WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(moved)) for b in range(256)]


BYTES = byte_letters()
SPLIT = re.compile("[\t-\r ]+")
BLANK = re.compile("[\t-\r ]")
#: Runs of the marks . , ; : ? ! beside ASCII or Latin-1 letters, digits and white space are tokens of their own.
PLAIN = re.compile(r"[^\t-\r .,;:?!]+|[.,;:?!]+")
MIXED = re.compile(r"[.,;:?!][^\t-\r .,;:?!A-Za-z0-9À-ÖØ-öø-ÿ]|[^\t-\r .,;:?!A-Za-z0-9À-ÖØ-öø-ÿ][.,;:?!]")


#: Settings of a vocabulary file that the cuts and joins here hold for (fixed values).
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_vocabulary(spec: dict, path: str) -> None:
    """Raises ValueError for a file with other settings."""
    for part, want in ((spec, SETTINGS), (spec.get("model", {}), MODEL), *((t, PLAIN_TOKEN) for t in spec.get("added_tokens", []))):
        for k, v in want.items():
            if part.get(k, False if v is False else None) != v:
                raise ValueError(f"{path}: {k} is {part.get(k)!r}; tree concatenation holds for {v!r} only")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merger:
    """Byte-pair merges of one unsplit unit, by rank and then from the left, with a heap."""

    def __init__(self, model: dict):
        self.ids = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}

    def encode(self, symbols: list[str]) -> list[str]:
        text, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if text[i] != a or j >= len(text) or text[j] != b:
                continue
            text[i], text[j] = a + b, None
            after[i] = k = after[j]
            if k < len(text):
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < len(text) and (r := self.ranks.get((text[x], text[y]))) is not None:
                    heapq.heappush(heap, (r, x, text[x], text[y]))
        return [t for t in text if t is not None]

    def concatenated(self, symbols: list[str], leaf: int) -> list[str]:
        """encode() of many symbols by tree concatenation; the result is equal."""
        if len(symbols) <= leaf:
            return self.encode(symbols)
        middle = len(symbols) // 2
        return self.join(self.concatenated(symbols[:middle], leaf), self.concatenated(symbols[middle:], leaf))

    def join(self, left: list[str], right: list[str], window: int = 16) -> list[str]:
        """Tokens of two neighbours as one: a window around the join is encoded anew and grown until it shares a token with each side."""
        while True:
            low, before, high, after = len(left), 0, 0, 0
            while low and before < window:
                low -= 1
                before += self.width(left[low])
            while high < len(right) and after < window:
                after += self.width(right[high])
                high += 1
            inner = self.encode(self.symbols(left[low:] + right[:high]))
            spans = self.spans(inner, 0)
            mine = {x: low + k for k, x in enumerate(self.spans(left[low:], 0))}
            theirs = {x: k for k, x in enumerate(self.spans(right[:high], before))}
            first, i = (0, 0) if low == 0 else next(((k, mine[x]) for k, x in enumerate(spans) if x in mine), (None, None))
            last, j = (len(inner), len(right)) if high == len(right) else next(((k + 1, theirs[spans[k]] + 1) for k in range(len(spans) - 1, -1, -1) if spans[k] in theirs), (None, None))
            if first is not None and last is not None and first < last:
                return left[:i] + inner[first:last] + right[j:]
            window *= 2

    @staticmethod
    def width(token: str) -> int:
        """Symbols in a token; the mark of a word's end belongs to its last one."""
        return len(token) - 4 if token.endswith("</w>") and len(token) > 4 else len(token)

    @staticmethod
    def symbols(tokens: list[str]) -> list[str]:
        out: list[str] = []
        for t in tokens:
            if t.endswith("</w>") and len(t) > 4:
                out += t[:-4]
                out[-1] += "</w>"
            else:
                out += t
        return out

    def spans(self, tokens: list[str], at: int) -> list[tuple[int, int]]:
        out = []
        for t in tokens:
            out.append((at, at := at + self.width(t)))
        return out


class Encoder:
    """Text to ids and their decoded text, both joined by a space."""

    def __init__(self, path: str, leaf: int = 2048, kept: int = 120_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        check_vocabulary(self.spec, path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf, self.kept, self.path = leaf, kept, path
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) if specials else "(?!)")
        self.merger = Merger(self.spec.pop("model"))
        self.pieces: dict[str, tuple[str, str]] = {}
        self.joins = 0

    def cut(self, text: str, whole: bool) -> list[str]:
        """text in pieces: `whole` ones between white space, else lowered and with marks apart. Only ASCII letters change case here, whatever
        else is normalised is left to the library."""
        if whole:
            return [p for p in SPLIT.split(text) if p]
        return PLAIN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))

    def kept_whole(self, text: str) -> bool:
        """Whether the text has marks or special tokens that must stay with what is beside them."""
        return bool(self.special.search(text) or MIXED.search(text))

    def piece(self, piece: str) -> tuple[str, str]:
        if len(piece) > self.leaf:
            ids = self.long_piece(piece)
        elif WORDS.fullmatch(piece):  # one unit that normalising only lowers: the model alone
            ids = [t.id for t in self.library.model.tokenize("".join([BYTES[b] for b in piece.lower().encode()]))]
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return " ".join(map(str, ids)), self.library.decode(ids, skip_special_tokens=False)

    def units(self, piece: str) -> Iterator[tuple[str, bool]]:
        """The library's own split of a piece: units, and special tokens with True."""
        at = 0
        for m in [*self.special.finditer(piece), None]:
            plain = piece[at : m.start() if m else len(piece)]
            if plain:
                for unit, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(plain)):
                    yield unit, False
            if m:
                yield m[0], True
                at = m.end()

    def long_piece(self, piece: str) -> list[int]:
        """Ids of a piece whose units may be of any length, by tree concatenation."""
        tokens: list[str] = []
        for unit, special in self.units(piece):
            tokens += [unit] if special else self.merger.concatenated([*unit[:-1], unit[-1] + "</w>"], self.leaf)
        return self.ids(tokens)

    def ids(self, tokens: list[str]) -> list[int]:
        known = self.merger.ids
        return [known[t] if t in known else self.library.token_to_id(t) for t in tokens]

    def encoded(self, text: str, whole: bool) -> list[tuple[str, str]]:
        """Ids and decoded text of each piece."""
        known = self.pieces
        if len(known) > self.kept:  # the older half goes
            for p in [*known][: self.kept // 2]:
                del known[p]
        got = []
        for p in self.cut(text, whole):
            e = known.get(p)
            if e is None:
                e = self.piece(p)
                if len(p) <= 64:
                    known[p] = e
            got.append(e)
        return got

    def concatenated(self, text: str, low: int, high: int, whole: bool) -> list[tuple[str, str]]:
        """encoded(text[low:high]) by tree concatenation; the result is equal."""
        if high - low <= self.leaf:
            return self.encoded(text[low:high], whole)
        middle = (low + high) // 2
        return self.join(text, low, middle, high, self.concatenated(text, low, middle, whole), self.concatenated(text, middle, high, whole), whole)

    def join(self, text: str, low: int, at: int, high: int, left: list, right: list, whole: bool, window: int = 16) -> list[tuple[str, str]]:
        """Pieces of text[low:at] and text[at:high] as those of text[low:high]."""
        self.joins += 1
        while True:
            start, end = max(low, at - window), min(high, at + window)
            if start > low:
                m = BLANK.search(text, start, at)
                start = m.start() if m else at
            if end < high:
                end = at + max((m.start() for m in BLANK.finditer(text[at:end])), default=0)
            tail, head = len(self.cut(text[start:at], whole)), len(self.cut(text[at:end], whole))
            if (start == low or tail) and (end == high or head):
                inner = self.encoded(text[start:end], whole)
                if (start == low or inner[0] == left[-tail]) and (end == high or inner[-1] == right[head - 1]):
                    return left[: len(left) - tail] + inner + right[head:]
            window *= 2

    def encode(self, text: str | None) -> tuple[str, str]:
        """Ids and decoded text, each joined by one space."""
        text = text or ""
        got = self.concatenated(text, 0, len(text), self.kept_whole(text))
        return " ".join([a for a, _ in got if a]), " ".join([b for a, b in got if a])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def decode(ids: list[int], path: str | None = None) -> str:
    """The library's decode(ids, skip_special_tokens=False)."""
    return encoder(path or vocabulary_path()).library.decode(ids, skip_special_tokens=False)


def _result(doc_id, kept, tokens: list[tuple[str, str]], digest: bool, schema: T.StructType) -> pa.RecordBatch:
    """A batch of results from ids and decoded text, each joined by a space."""
    n = pa.array([i.count(" ") + 1 if i else 0 for i, _ in tokens], pa.int64())
    if digest:
        what = [pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in tokens], pa.string()) for k in (0, 1)]
    else:
        what = [pa.array([[int(x) for x in i.split()] for i, _ in tokens], pa.list_(pa.int32())), pa.array([t for _, t in tokens], pa.string())]
    return pa.RecordBatch.from_arrays([doc_id, *kept, n, *what], schema.names)


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False, keep: tuple[str, ...] = (), part: int = 1 << 16) -> DataFrame:
    """doc_id, `keep`, n_tokens, and ids (array<int>) with decoded, or with `digest` the hashes of both.

    Documents with an unsplit stretch of at least `part` characters are spread over rows, see encode_spread().
    """
    at = path or vocabulary_path()
    what = (("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digest else (("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()))
    schema = T.StructType([docs.schema[c] for c in ("doc_id", *keep)]).add("n_tokens", T.LongType())
    for name, kind in what:
        schema = schema.add(name, kind)
    rows = docs.select("doc_id", "text", *keep)
    unsplit = F.coalesce((F.octet_length("text") >= part) & F.col("text").rlike(f"{WORD[:-1]}{{{part}}}"), F.lit(False))  # the pattern sees long texts only

    def run(batches):
        own = encoder(at)
        for batch in batches:
            yield _result(batch["doc_id"], [batch[k] for k in keep], [own.encode(t) for t in batch["text"].to_pylist()], digest, schema)

    if rows.where(unsplit).limit(1).count() == 0:
        return rows.mapInArrow(lean(run), schema)
    return rows.where(~unsplit).mapInArrow(lean(run), schema).unionByName(encode_spread(rows.where(unsplit), at, digest, keep, part, schema))


def encode_spread(rows: DataFrame, at: str, digest: bool, keep: tuple[str, ...], part: int, schema: T.StructType) -> DataFrame:
    """Documents with long units: leaves of up to `part` symbols are rows of their own, encoded in parallel, and neighbours are joined
    round by round, each round halving the leaves of a unit."""
    rows, _ = materialize(rows.withColumn("__tl_row", F.monotonically_increasing_id()), "bpe-long")
    fields = "row bigint, seq int, leaf int, leaves int, tokens array<string>"
    kinds = pa.schema([("row", pa.int64()), ("seq", pa.int32()), ("leaf", pa.int32()), ("leaves", pa.int32()), ("tokens", pa.list_(pa.string()))])

    def leaves(batches):
        own = encoder(at)
        for batch in batches:
            for row, text in zip(batch["__tl_row"].to_pylist(), batch["text"].to_pylist()):
                out, done = [], []
                for piece in own.cut(text, own.kept_whole(text)):
                    for unit, special in own.units(piece):
                        if special or len(unit) <= part:
                            done += [unit] if special else own.merger.encode([*unit[:-1], unit[-1] + "</w>"])
                            continue
                        out += [(0, 1, done)] if done else []
                        done = []
                        cuts = range(0, len(unit), part)
                        out += [(k, -len(cuts), [unit[c : c + part]]) for k, c in enumerate(cuts)]  # still to be encoded
                out += [(0, 1, done)] if done else []
                seq = -1
                for leaf, n, tokens in out:
                    seq += leaf == 0
                    yield pa.RecordBatch.from_pylist([{"row": row, "seq": seq, "leaf": leaf, "leaves": n, "tokens": tokens}], kinds)

    def encode(batches):
        own = encoder(at)
        for batch in batches:
            got = batch.to_pylist()
            for r in got:
                if r["leaves"] < 0:
                    r["leaves"] = -r["leaves"]
                    text = r["tokens"][0]
                    r["tokens"] = own.merger.encode([*text[:-1], text[-1] + "</w>"] if r["leaf"] == r["leaves"] - 1 else list(text))
            yield pa.RecordBatch.from_pylist(got, kinds)

    def joined(batches):
        own = encoder(at)
        for batch in batches:
            got = batch.to_pylist()
            for r in got:
                pair = r.pop("pair")
                r["tokens"] = own.merger.join(pair[0]["tokens"], pair[1]["tokens"]) if len(pair) == 2 else pair[0]["tokens"]
            yield pa.RecordBatch.from_pylist(got, kinds)

    parts = rows.select("__tl_row", "text").mapInArrow(lean(leaves, 1), fields).repartition("row", "seq", "leaf").mapInArrow(lean(encode, 1), fields)
    parts, _ = materialize(parts, "bpe-leaves")
    while (parts.agg(F.max("leaves")).first()[0] or 1) > 1:
        half = F.shiftright("leaf", 1).alias("leaf")
        pairs = parts.groupBy("row", "seq", half, F.shiftright(F.col("leaves") + 1, 1).alias("leaves")).agg(F.array_sort(F.collect_list(F.struct(F.col("leaf").alias("k"), "tokens"))).alias("pair"))
        parts, _ = materialize(pairs.mapInArrow(lean(joined, 1), fields), "bpe-leaves")

    def finish(batches):
        own = encoder(at)
        for batch in batches:
            tokens = [[t for x in (parts or []) for t in x["tokens"]] for parts in batch["__tl_parts"].to_pylist()]
            ids = [own.ids(t) for t in tokens]
            yield _result(batch["doc_id"], [batch[k] for k in keep], [(" ".join(map(str, t)), own.library.decode(t, skip_special_tokens=False)) for t in ids], digest, schema)

    whole = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "tokens"))).alias("__tl_parts"))
    return rows.drop("text").join(whole.withColumnRenamed("row", "__tl_row"), "__tl_row", "left").drop("__tl_row").mapInArrow(lean(finish, 1), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)
