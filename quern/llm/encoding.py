"""Garbled text from wrong character encoding.

A multinomial classifier over hashed byte bigrams tells clean text from the text each chain of
encodings makes of it.  It is trained on clean rows of a bounded sample, garbled
synthetically by every chain.  A document's words with characters beyond ASCII are
scored in order; the stretch that most favours a chain over clean text is inverted by
that chain, and counts if it decodes strictly and reads cleaner than before.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents drawn for the training sample, of which those with characters beyond ASCII are fitted on (the bound of the fit; all documents are classified).
SAMPLE_DOCS = 6_000
HASH_BITS = 15
#: Least log-likelihood gain of a stretch over clean text; swaps of single-byte encodings decode whatever they are given, so
#: without control codes in the stretch they need more than chains over UTF-8, whose bytes rarely decode by chance.
LEAST_GAIN, SWAP_GAIN = 9.0, 50.0
#: A document with a gain from this on (LEAST_GAIN if it holds control codes) is left out of the clean rows of the second training.
EXCLUDE_GAIN = 40.0
#: Of chains this near to the best over a stretch, the first in the list is taken.
NEAR_GAIN = 4.0
#: Share of upper-cased words added to every class, since texts in capitals are rare in a sample.
CAPITALS = 0.1
#: A worker's memory of scored words.
CACHE_UNITS = 200_000

#: (written in, read as), applied one after the other: fixed values, encodings that are commonly confused, the commoner ones first within a group.
CHAINS = [
    [("utf-8", "latin-1")],
    [("utf-8", "cp1252")],
    [("utf-8", "cp1250")],
    [("utf-8", "cp1251")],
    [("utf-8", "cp1254")],
    [("utf-8", "cp1258")],
    [("utf-8", "cp437")],
    [("utf-8", "cp850")],
    [("utf-8", "cp852")],
    [("utf-8", "cp866")],
    [("utf-8", "koi8-r")],
    [("utf-8", "mac_roman")],
    [("utf-8", "mac_cyrillic")],
    [("utf-8", "iso8859-2")],
    [("utf-8", "iso8859-15")],
    [("utf-8", "gbk")],
    [("utf-8", "big5")],
    [("utf-8", "shift_jis")],
    [("utf-8", "cp949")],
    [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    [("utf-8", "cp1251"), ("utf-8", "cp1251")],
    [("utf-8", "cp437"), ("utf-8", "cp437")],
    [("cp1252", "utf-8")],
    [("cp1252", "latin-1")],
    [("cp1252", "cp437")],
    [("cp1252", "cp850")],
    [("cp1252", "mac_roman")],
    [("cp1252", "cp1250")],
    [("cp1252", "cp1251")],
    [("cp1252", "koi8-r")],
    [("cp437", "cp1252")],
    [("cp437", "latin-1")],
    [("cp850", "cp1252")],
    [("cp850", "latin-1")],
    [("cp850", "cp437")],
    [("mac_roman", "cp1252")],
    [("mac_roman", "latin-1")],
    [("cp1251", "latin-1")],
    [("cp1251", "cp1252")],
    [("cp1251", "koi8-r")],
    [("cp1251", "cp866")],
    [("cp1251", "mac_cyrillic")],
    [("cp1251", "utf-8")],
    [("koi8-r", "cp1251")],
    [("koi8-r", "latin-1")],
    [("koi8-r", "cp1252")],
    [("koi8-r", "cp866")],
    [("cp866", "cp1251")],
    [("cp866", "cp1252")],
    [("cp866", "latin-1")],
    [("cp866", "koi8-r")],
    [("cp866", "cp437")],
    [("mac_cyrillic", "cp1251")],
    [("gbk", "latin-1")],
    [("gbk", "cp1252")],
    [("gbk", "utf-8")],
    [("gbk", "cp1251")],
    [("big5", "latin-1")],
    [("big5", "cp1252")],
]

LOST = "�"
#: Characters beyond ASCII that carry evidence: spaces and invisible marks don't, but a no-break space does beside others.
_BEYOND = r"[^\x00-\x7f\xa0\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]"
#: A word with such characters, with a few letters around them; what is restored may also be a lone no-break space.
UNIT = re.compile(rf"[A-Za-z]{{0,2}}(?:\xa0*{_BEYOND}+\xa0*[A-Za-z]{{0,3}})+")
ANY_UNIT = re.compile(rf"[A-Za-z]{{0,2}}(?:(?:{_BEYOND}|\xa0)+[A-Za-z]{{0,3}})+")
#: Control codes that only a wrong reading leaves in a text.
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_SINGLE: dict[str, tuple | None] = {}


def _single(enc: str) -> tuple | None:
    """The 256 characters of a single-byte encoding and back; a byte without character stays the control code that readers make of it."""
    if enc not in _SINGLE:
        if enc in ("utf-8", "gbk", "big5", "shift_jis", "cp949"):
            _SINGLE[enc] = None
        else:
            chars = [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256)]
            _SINGLE[enc] = ("".join(chars), codecs.charmap_build("".join(chars)))
    return _SINGLE[enc]


def write_as(text: str, enc: str, errors: str = "strict") -> bytes:
    table = _single(enc)
    if table is None:
        return text.encode(enc, errors)
    return codecs.charmap_encode(text, errors, table[1])[0]


def read_as(data: bytes, enc: str, errors: str = "strict") -> str:
    table = _single(enc)
    if table is None:
        return data.decode(enc, errors)
    return codecs.charmap_decode(data, "strict", table[0])[0]


def garble(text: str, chain: list[tuple[str, str]]) -> str:
    for written, read in chain:
        text = read_as(write_as(text, written, "replace"), read, "replace")
    return text


def restore(text: str, chain: list[tuple[str, str]]) -> str | None:
    """The text before the chain; null unless every step decodes strictly."""
    try:
        for written, read in reversed(chain):
            text = read_as(write_as(text, read), written)
    except UnicodeError:
        return None
    return text


def bigrams(data: bytes) -> np.ndarray:
    """Hashed bigrams with at least one byte beyond ASCII."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    pair = b[:-1] << 8 | b[1:]
    pair = pair[(pair & 0x8080) != 0]
    return (pair * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _counts(units: list[str], chain: list[tuple[str, str]] | None) -> np.ndarray:
    """Bigram counts of units after a chain; units that it leaves as they are don't count for it."""
    if chain is not None:
        made = zip(units, garble("\n".join(units), chain).split("\n"))
        units = [g for u, g in made if g != u and g.count("?") * 2 <= len(g)]
    data = ("\n" + "\n".join(units) + "\n").encode("utf-8", "surrogatepass")
    return np.bincount(bigrams(data), minlength=1 << HASH_BITS).astype(np.float64)


@dataclass
class Model:
    """`weights[h, 0]`: log-likelihood of a bigram in clean text; `weights[h, 1 + c]`: the same for chain c."""

    weights: np.ndarray

    def score(self, unit: str) -> np.ndarray:
        return self.weights[bigrams(("\n" + unit + "\n").encode("utf-8", "surrogatepass"))].sum(axis=0)


def fit(texts: list[str]) -> Model:
    """Train on texts some of which may be garbled: what a first model finds garbled is left out of the second."""
    model, clean = None, texts
    for _ in range(2):
        if model is not None:
            seen: dict[str, tuple[np.ndarray, float]] = {}
            garbled = lambda t: find_garbled(t, model, seen, least=LEAST_GAIN if CONTROL.search(t) else EXCLUDE_GAIN, repair=False)[0]  # noqa: B023, E731
            clean = [t for t in texts if not garbled(t)]
        tally: dict[str, int] = {}
        for t in clean:
            for u in UNIT.findall(t):
                if LOST not in u:
                    tally[u] = tally.get(u, 0) + 1
        units = [u for u, n in tally.items() for _ in range(n)]
        units += [c for u in units[:: round(1 / CAPITALS)] if (c := u.upper()) != u]
        table = np.stack([_counts(units, chain) for chain in [None, *CHAINS]], axis=1)
        # rates for each bigram of clean text, so that a chain that only some languages survive isn't favoured for being narrow
        rate = table / max(table[:, 0].sum(), 1) * 1e6
        model = Model(np.log((rate + 0.5) / 1e6).astype(np.float32))
    return model


def chain_name(steps: list[tuple[str, str]]) -> str:
    return "+".join(f"{w}>{r}" for w, r in steps)


def _best_stretch(gains: np.ndarray) -> tuple[float, int, int, int]:
    """`gain, chain, from, to`: the run of rows with the largest sum in any column."""
    ends = np.vstack([np.zeros((1, gains.shape[1])), np.cumsum(gains, axis=0)])
    lows = np.minimum.accumulate(ends, axis=0)[:-1]
    rise = ends[1:] - lows
    to, chain = np.unravel_index(int(rise.argmax()), rise.shape)
    start = int(np.flatnonzero(ends[: to + 1, chain] == lows[to, chain])[-1])
    return float(rise[to, chain]), int(chain), start, int(to) + 1


def _units(text: str, model: Model, seen: dict[str, tuple[np.ndarray, float]], least: float) -> tuple[list[re.Match], np.ndarray] | None:
    """The words of a text that carry evidence, and their scores; none if even all gains together stay under `least`."""
    units, rows, most = list(UNIT.finditer(text)), [], 0.0
    for m in units:
        u = m.group()
        row = seen.get(u)
        if row is None:
            score = model.score(u)
            row = score, max(0.0, float(score[1:].max() - score[0]))
            if len(u) <= 64:
                if len(seen) > CACHE_UNITS:
                    seen.clear()
                seen[u] = row
        rows.append(row[0])
        most += row[1]
    return (units, np.array(rows)) if most >= least else None


def _mended(unit: str, chain: int, model: Model) -> str:
    """A word of a stretch as it was before the chain; as it is if it favours clean text or doesn't decode."""
    if LOST in unit:
        return unit
    score = model.score(unit)
    if UNIT.search(unit) and score[1 + chain] <= score[0]:
        return unit
    fixed = restore(unit, CHAINS[chain])
    return unit if fixed is None else fixed


def find_garbled(text: str, model: Model, seen: dict[str, tuple[np.ndarray, float]], least: float = LEAST_GAIN, repair: bool = True) -> tuple[bool, str, list[str], bool]:
    """`found, restored text, chains, whole`; `whole` if every stretch found could be restored.

    The stretch with the largest gain is restored, until none is left.  A stretch
    that doesn't decode, or doesn't read cleaner then, is not looked at again for that chain; one that holds
    replacement characters is found, though its text is lost.
    """
    found, chains, whole = False, [], True
    barred: dict[str, set[int]] = {}
    bar = lambda unit, chains: barred.setdefault(unit, set()).update(chains)
    # every round restores a stretch or bars a word for a chain, so the bound is never met
    for _ in range(len(CHAINS) * (len(text) + 1)):
        scored = _units(text, model, seen, least)
        if scored is None:
            break
        units, scores = scored
        gains = scores[:, 1:] - scores[:, :1]
        if barred:
            for i, m in enumerate(units):
                if at := barred.get(m.group()):
                    at = list(at)
                    gains[i, at] = np.minimum(gains[i, at], -50.0)
        gain, chain, start, to = _best_stretch(gains)
        if gain < least:
            break
        chain = int(np.flatnonzero(gains[start:to].sum(axis=0) >= gain - NEAR_GAIN)[0])
        steps = CHAINS[chain]
        kept = lost = cleaner = 0.0
        controls = False
        for i in range(start, to):
            u = units[i].group()
            fixed = None if LOST in u else restore(u, steps)
            if fixed is not None and fixed != u:
                kept += float(gains[i, chain])
                cleaner += float(model.score(fixed)[0]) - float(scores[i, 0])
                controls = controls or CONTROL.search(u) is not None
            else:
                lost += float(gains[i, chain]) if LOST in u else 0.0
                bar(u, [chain])
        need = least if controls or any(w == "utf-8" for w, _ in steps) else max(least, SWAP_GAIN)
        ok = kept >= need and cleaner > 0
        if ok or lost >= least:
            found = True
            chains.append(chain_name(steps))
            if not repair:
                break
        if lost >= least:
            whole = False
            for i in range(start, to):
                if LOST in units[i].group():
                    bar(units[i].group(), range(len(CHAINS)))
        if ok:
            a, b = units[start].start(), units[to - 1].end()
            text = text[:a] + ANY_UNIT.sub(lambda m: _mended(m.group(), chain, model), text[a:b]) + text[b:]  # noqa: B023
        else:
            for i in range(start, to):
                bar(units[i].group(), [chain])
    return found, text, list(dict.fromkeys(chains)), whole and found


BEYOND_ASCII = r"[^\x00-\x7f]"


def _drawn(key: str, share: float):
    """Whether a row is in a sample of this share, by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1


def train(docs: DataFrame, key: str, text: str, most: float = 1.0) -> Model:
    """Fit on those with characters beyond ASCII among about SAMPLE_DOCS rows (at most a share `most`), drawn by a hash of the key."""
    share = min(most, SAMPLE_DOCS / max(docs.count(), 1))
    return fit([r[0] for r in docs.where(_drawn(key, share)).where(F.col(text).rlike(BEYOND_ASCII)).select(text).collect()])


def held_out_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`chain, lines, found, restored` for each chain: how much of what it garbles is found and put right exactly.

    The model is fitted on half the documents at most.  Each document outside its sample in which it finds nothing
    garbled gets one line garbled by one chain, both chosen by a hash of the key: a line with two words beyond ASCII at
    least, which the chain changes without losing characters.  An empty table gives no rows.
    """
    share = min(0.5, SAMPLE_DOCS / max(docs.count(), 1))
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, 0.5).weights)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, seen = Model(weights.value), {}
        for batch in batches:
            out = []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = t.split("\n")
                at = [i for i, line in enumerate(lines) if len(UNIT.findall(line)) > 1]
                if not at or find_garbled(t, local, seen, repair=False)[0]:
                    continue
                i, c = at[h // len(CHAINS) % len(at)], h % len(CHAINS)
                bad = garble(lines[i], CHAINS[c])
                if bad == lines[i] or LOST in bad or restore(bad, CHAINS[c]) != lines[i]:
                    continue
                found, fixed, _, _ = find_garbled("\n".join([*lines[:i], bad, *lines[i + 1 :]]), local, seen)
                out.append((chain_name(CHAINS[c]), 1, int(found), int(fixed == t)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["chain", "lines", "found", "restored"])

    rest = docs.where(~_drawn(key, share) & F.col(text).rlike(BEYOND_ASCII)).select(text, F.pmod(F.xxhash64(F.lit("line"), key), F.lit(1 << 40)).alias("h"))
    rows = rest.mapInArrow(tried, "chain string, lines long, found long, restored long")
    return rows.groupBy("chain").agg(*[F.sum(c).alias(c) for c in ("lines", "found", "restored")])


def garbled_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, chains, whole, restored` for each row whose text, or a stretch of it, was read in a wrong encoding.

    `chains` names the encodings (`written>read`, `+` between the steps of one chain),
    `restored` is the text with every stretch that decodes strictly put right, `whole` whether
    that holds for all of them.  Null, empty and plain ASCII texts are no case; a row that
    occurs again comes out again; an empty table gives no rows; other columns play no role.
    """
    model = train(docs, key, text)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, seen = Model(weights.value), {}
        for batch in batches:
            at, chains, whole, texts = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                found, fixed, names, all_of_it = find_garbled(t.as_py(), local, seen)
                if found:
                    at.append(i)
                    chains.append(names)
                    whole.append(all_of_it)
                    texts.append(fixed)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(chains, pa.list_(pa.string())), pa.array(whole, pa.bool_()), pa.array(texts, pa.string())], names=[key, "chains", "whole", "restored"])

    schema = T.StructType([docs.schema[key], T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("whole", T.BooleanType()), T.StructField("restored", T.StringType())])
    return docs.select(key, text).where(F.col(text).rlike(BEYOND_ASCII)).mapInArrow(scan, schema)
