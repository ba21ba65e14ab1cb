"""Encoding and decoding with public byte-pair vocabularies: whole texts, long unsplit text by tree concatenation.

The library encodes each distinct chunk of text once per worker and the ids of a
text are gathered from that table. A chunk starts where every encoding has a
token boundary (an optional blank and what follows up to the next white space),
so the ids of the chunks are the ids of the text.

A pretoken (what the vocabulary's pattern leaves whole) longer than ``leaf``
characters is cut into halves down to leaves. Leaves are rows of their own and
are encoded in parallel. Two halves meet by re-encoding the text of the last w
tokens of the left and the first w of the right, w doubling until the outermost
token on each side stays as it was. A byte-pair encoding is right exactly if
each adjacent pair of tokens is the encoding of the pair's text; the pairs
inside the window come from one encoding, those outside from the halves', so the
result equals the library's for the whole.

Rules: null text is empty text (no ids, empty decoding); rows repeat as they
come, with null or repeated ids; other columns of the input are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from corridor_spark.llm.common import parts, slices, stage, texts

#: White space as Unicode has it, which is what the vocabularies' patterns mean by it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEAF = 16_384

_CHUNK = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Fixed value: the pattern of byte-level vocabularies.
_PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts of Latin-1 characters, whose letters and numbers can be listed.
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_LOWER, _LETTERS = re.compile("[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ ]+"), re.compile("[a-zªµºß-öø-ÿ]+")
_KEPT: dict = {}


def kept(key, make: Callable):
    """Make a worker's table once and keep it for the tasks that follow."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """Ids of texts from a bounded table of chunk encodings.

    ``keep`` bounds the table: beyond it, the half that was used least is
    forgotten. What is forgotten is encoded anew when it comes again, so results
    cannot differ. ``words`` is for vocabularies that drop white space and case
    and mark the ends of words, else blanks lead the words.
    """

    def __init__(self, path: str, words: bool = False, keep: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.bound = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words, self.keep = words, keep
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.edge = np.array([n.endswith("</w>") if words else n.startswith("Ġ") for n in names])
        self.easy = self.tokenizer
        if words:  # for what is in lower case already
            self.easy = Tokenizer.from_file(path)
            self.easy.normalizer = normalizers.Sequence([])
            self.easy.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table: dict[str, int] = {}
        self.ids, self.first, self.size, self.used = (np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3)))

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def cut(self, text: str) -> list[str]:
        """Chunks of a text; special tokens bound the text on either side."""
        if self.bound.search(text):
            return [c for i, part in enumerate(self.bound.split(text)) for c in ([part] if i % 2 else self.cut(part))]
        latin = latin_1(text)
        if self.words:
            return _LOWER.findall(text.lower()) if latin and "'" not in text else text.split(" ")
        return (_LATIN if latin else _CHUNK).findall(text)

    def _learn(self, fresh: set[str]) -> None:
        easy = [c for c in fresh if (_LETTERS.fullmatch(c) if self.words else c[:1] == " " and c[1:].isalpha())]
        rest = fresh.difference(easy)
        odd = [c for c in rest if any(s in c for s in self.special)]
        even = list(rest.difference(odd))
        ids = np.array(self.easy.encode_batch_fast([" " * self.words + (" " if self.words else "").join(easy)],
                                                   add_special_tokens=False)[0].ids, np.int32)
        edges = np.flatnonzero(self.edge[ids])  # one for each of the easy chunks: its last id, or its first
        size = [np.diff(np.append(-1, edges)) if self.words else np.diff(np.append(edges, len(ids)))]
        more = np.array(self.plain(self.mark.join(even)), np.int32)
        ends = np.append(np.flatnonzero(more == self.mark_id), [len(more)] * bool(even)).astype(np.int64)
        alone = [self.plain(c) for c in odd]
        size = np.concatenate([*size, np.diff(np.append(-1, ends)) - 1, [len(a) for a in alone]]).astype(np.int64)
        self.table.update(zip(easy + even + odd, range(len(self.size), len(self.size) + len(fresh))))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.ids = np.concatenate([self.ids, ids, more[more != self.mark_id], *(np.array(a, np.int32) for a in alone)])
        self.size, self.used = np.append(self.size, size), np.append(self.used, np.zeros(len(fresh), np.int64))

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.keep // 2])
        names = list(self.table)
        self.ids = gather(self.ids, self.first[stay], self.size[stay])
        self.size, self.used = self.size[stay], self.used[stay] // 2
        self.first = np.cumsum(self.size) - self.size
        self.table = {names[i]: k for k, i in enumerate(stay)}

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        if len(self.table) > self.keep:
            self._forget()
        cut = [self.cut(t) for t in batch]
        flat = list(chain.from_iterable(cut))
        at = np.array(list(map(self.table.get, flat, repeat(-1))), np.int64)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            late = [flat[i] for i in missing]
            self._learn(set(late))
            at[missing] = list(map(self.table.__getitem__, late))
        self.used += np.bincount(at, minlength=len(self.used))
        size = self.size[at]
        total = np.append(0, np.cumsum(size))
        ends = np.cumsum([len(c) for c in cut], dtype=np.int64)
        return gather(self.ids, self.first[at], size), np.diff(np.append(0, total[ends]))


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenate the runs of ``flat`` that start at ``first`` and are ``size`` long."""
    total = int(size.sum())
    return flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)]


def byte_table(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i)
        out.append(bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode())
    return out


def digests(ids: list[int], table: list[bytes], decimals: list[str]) -> tuple[str, str]:
    """SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    decoded = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
    return (hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


# ---- long unsplit text ---------------------------------------------------------------------------------------------


def whole_encoder(path: str) -> Callable[[str], list[int]]:
    """Byte-pair encoding of a string as one pretoken."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the tree that halves the text until no piece is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


def meet(left: list[int], right: list[int], encode: Callable[[str], list[int]], table: list[bytes]) -> list[int]:
    """Ids of the concatenation of two encoded texts."""
    w = 1
    while left and right:
        a, b = max(0, len(left) - w), min(w, len(right))
        w *= 2
        try:
            window = encode(b"".join(map(table.__getitem__, left[a:] + right[:b])).decode())
        except UnicodeDecodeError:  # a token ends within a character
            continue
        if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[:a] + window + right[b:]
    return left + right


def tree(pieces: list[list[int]], sizes: list[int], leaf: int, encode: Callable, table: list[bytes]) -> list[int]:
    """Join encoded leaves in the order in which ``halves`` cut them."""
    total = sum(sizes)
    if total <= leaf or len(pieces) == 1:
        return pieces[0]
    k, held = 0, 0
    while held < total // 2:
        held, k = held + sizes[k], k + 1
    return meet(tree(pieces[:k], sizes[:k], leaf, encode, table), tree(pieces[k:], sizes[k:], leaf, encode, table), encode, table)


def long_pieces(text: str, bound: regex.Pattern, leaf: int) -> Iterator[tuple[int, int, list[str]]]:
    """(number, leaf's number, pretokens): runs of ordinary pretokens under -1, long pretokens as leaves."""
    number, held = 0, []
    for i, part in enumerate(bound.split(text)):
        for token in [part] if i % 2 else _PRETOKEN.findall(part):
            if i % 2 or len(token) <= leaf:
                held.append(token)
                continue
            if held:
                yield number, -1, held
                number, held = number + 1, []
            for k, piece in enumerate(halves(token, leaf)):
                yield number, k, [piece]
            number += 1
    if held:
        yield number, -1, held


def has_long(text: str, leaf: int) -> bool:
    """A run that white space does not split, or of white space, is longer than ``leaf``."""
    return len(text) > leaf and any(len(c) > leaf for c in _CHUNK.findall(text))


def encode_texts(docs: DataFrame, path: str, leaf: int = LEAF, with_ids: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``more``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Texts with a run of more than ``leaf`` characters that no pretoken boundary is sure to split go
    through the tree; each distinct such text once.
    """
    spark = docs.sparkSession
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    own = texts(docs, *more)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept((path, "chunks"), lambda: ChunkEncoder(path))
        table = kept((path, "bytes"), lambda: byte_table(path))
        decimals = kept((path, "decimals"), lambda: [str(i) for i in range(len(table))])
        for part in slices(batches):
            rows = part.column("text").to_pylist()
            late = [has_long(t, leaf) for t in rows]
            flat, size = encoder.encode(["" if x else t for t, x in zip(rows, late)])
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
            at = 0
            for n, x in zip(size.tolist(), late):
                ids = flat[at : at + n].tolist()
                at += n
                a, b = (None, None) if x else digests(ids, table, decimals)
                for k, v in (("n_tokens", None if x else n), ("ids_sha256", a), ("decoded_sha256", b)):
                    out[k].append(v)
                out["ids"].append(ids if with_ids else None)
            columns = [part.column(c) for c in ("doc_id", *more)] + [pa.array(out["n_tokens"], pa.int64()),
                       pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            columns += [pa.array(out["ids"], pa.list_(pa.int32()))] * with_ids
            columns += [pa.array([t if x else None for t, x in zip(rows, late)], pa.string())]
            names = ["doc_id", *more, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, "long_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    first = stage(own.mapInArrow(short, f"{types}, {result}, long_text string"), "bpe")
    late = first.where("long_text IS NOT NULL").withColumn("key", F.sha2("long_text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = kept((path, "chunks"), lambda: ChunkEncoder(path)).bound
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("long_text").to_pylist()):
                number, leaf_no, tokens = zip(*long_pieces(text, bound, leaf))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(number)), pa.array(number, pa.int64()), pa.array(leaf_no, pa.int64()),
                                                  pa.array(tokens, pa.list_(pa.string()))], ["key", "number", "leaf_no", "tokens"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept((path, "chunks"), lambda: ChunkEncoder(path))
        whole = kept((path, "whole"), lambda: whole_encoder(path))
        for batch in batches:
            rows = batch.column("tokens").to_pylist()
            ids = [[i for t in row for i in (encoder.plain(t) if t in encoder.special else whole(t))] for row in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "number", "leaf_no")),
                                              pa.array([sum(map(len, row)) for row in rows], pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], ["key", "number", "leaf_no", "chars", "ids"])

    def join(pieces: pd.DataFrame) -> pd.DataFrame:
        whole = kept((path, "whole"), lambda: whole_encoder(path))
        table = kept((path, "bytes"), lambda: byte_table(path))
        decimals = kept((path, "decimals"), lambda: [str(i) for i in range(len(table))])
        ids: list[int] = []
        for _, run in pieces.sort_values(["number", "leaf_no"]).groupby("number"):
            ids += tree([list(map(int, x)) for x in run["ids"]], run["chars"].tolist(), leaf, whole, table)
        a, b = digests(ids, table, decimals)
        return pd.DataFrame({"key": [pieces["key"].iloc[0]], "n_tokens": [len(ids)], "ids_sha256": [a], "decoded_sha256": [b]}
                            | ({"ids": [ids]} if with_ids else {}))

    done = (late.select("key", "long_text").dropDuplicates(["key"])
            .mapInArrow(cut, "key string, number long, leaf_no long, tokens array<string>")
            .repartition(parts(spark), "key", "number", "leaf_no")
            .mapInArrow(encode, "key string, number long, leaf_no long, chars long, ids array<int>")
            .groupBy("key").applyInPandas(join, f"key string, {result}"))
    names = ["doc_id", *more, *(c.split()[0] for c in result.split(", "))]
    tail = late.select("doc_id", *more, "key").join(done, "key").select(*names)
    return first.where("long_text IS NULL").select(*names).unionByName(tail)
