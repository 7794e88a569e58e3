"""Token counts with a whole-token shortcut.

Before the job, ``prove`` finds the vocabulary strings that are one pre-token and encode, alone, as
exactly one token. In the tasks a text is cut into pre-tokens; those in the proven set count one
token without any merging, and only the rest goes through the tokenizer's merges, each distinct
pre-token once per batch (a bounded memory keeps the counts of frequent ones).

The pre-token pattern is run by a regular-expression engine of our own choice, so ``prove`` also
compares it with the tokenizer's splitter on every code point of the basic plane, between letters,
digits, marks and spaces. A text that holds a code point where the two differ, a code point
beyond that plane, or the string of an added token goes to the tokenizer as a whole. So does every
text if the tokenizer is not a byte-level BPE without a normaliser.

Defined results: a null text is empty and has no tokens; repeated rows are counted each; very long
texts are cut into pre-tokens piece by piece; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the pre-token pattern of byte-level BPE, with ``[^\W\d_]`` for letters and ``\d`` for
#: numbers; where these classes are not the same, ``prove`` finds out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: A document above this many tokens is over the limit.
LIMIT = 1024
#: Distinct pre-tokens whose counts a worker remembers; beyond, it forgets and starts again.
REMEMBERED = 1_000_000
#: Pre-tokens of one text that are held at a time.
HELD = 1 << 18


class Proof(NamedTuple):
    """What was proven of a tokenizer: strings that are one token; a class of code points that make a
    text unsafe for the shortcut (a pattern), None if the shortcut never holds."""
    whole: frozenset[str]
    unsafe: str | None


def _tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others in order from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int]:
    """Bytes of each vocabulary string to its id."""
    chars = _byte_of_char()
    return {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items()}


def _is_plain(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or model.get("ignore_merges")
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        return False
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in pairs]
    letters = set(_byte_of_char())
    return all(a < b for a, b in zip(ids, ids[1:])) and letters <= set(model["vocab"]) and set().union(*model["vocab"]) <= letters


def prove(path: str) -> Proof:
    """Run once, before the job; takes some seconds."""
    t = _tokenizer(path)
    spec = json.loads(t.to_str())
    if not _is_plain(spec):
        return Proof(frozenset(), None)
    split = re.compile(PATTERN)
    strings = []
    for token in _ranks(spec):
        try:
            strings.append(token.decode())
        except UnicodeDecodeError:
            continue  # not a string of its own
    strings = [s for s in strings if split.findall(s) == [s]]
    whole = frozenset(s for s, e in zip(strings, t.encode_batch_fast(strings, add_special_tokens=False)) if len(e.ids) == 1)
    unsafe: list[list[int]] = []
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        probe = f"a{x}1{x}.{x} {x}  {x}{x}\n{x}'s"
        if [m.span() for m in split.finditer(probe)] == [span for _, span in t.pre_tokenizer.pre_tokenize_str(probe)]:
            continue
        if unsafe and unsafe[-1][1] == c - 1:
            unsafe[-1][1] = c
        else:
            unsafe.append([c, c])
    ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in unsafe)
    added = "|".join(re.escape(x["content"]) for x in spec.get("added_tokens", []))
    return Proof(whole, f"[{ranges}\\U00010000-\\U0010ffff]" + (f"|{added}" if added else ""))


class Counting:
    """Counts tokens of texts in one worker."""

    def __init__(self, path: str, proof: Proof):
        self.tokenizer, self.proof = _tokenizer(path), proof
        self.unsafe = re.compile(proof.unsafe) if proof.unsafe is not None else None
        self.known = dict.fromkeys(proof.whole, 1)
        self.split = re.compile(PATTERN)
        if self.unsafe is not None:  # merges one pre-token: the pattern takes it whole
            self.merges = tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=_ranks(json.loads(self.tokenizer.to_str())), special_tokens={})

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if self.unsafe is None or self.unsafe.search(text):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            n = 0
            for part in self._parts(text):
                rest = set(part).difference(self.known)
                if len(self.known) + len(rest) > len(self.proof.whole) + REMEMBERED:
                    self.known = dict.fromkeys(self.proof.whole, 1)
                    rest = set(part).difference(self.known)
                for s in rest:
                    self.known[s] = len(self.merges.encode_ordinary(s))
                n += sum(map(self.known.__getitem__, part))
            out.append(n)
        return out

    def _parts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= HELD:
            yield self.split.findall(text)
            return
        part = []
        for m in self.split.finditer(text):
            part.append(m.group())
            if len(part) >= HELD:
                yield part
                part = []
        yield part


_COUNTING: dict[str, Counting] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``path`` is the tokenizer's file, in the
    same place on every node. The proven set is bounded by the vocabulary, so it is broadcast."""
    proof = docs.sparkSession.sparkContext.broadcast(tuple(prove(path)))

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        if path not in _COUNTING:
            _COUNTING[path] = Counting(path, Proof(*proof.value))
        counting = _COUNTING[path]
        out = []
        for at in range(0, len(texts), 256):
            out += counting.count([x or "" for x in texts.slice(at, 256).to_pylist()])
        return pa.array(out, pa.int64())

    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
