"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language tells how long a match can run on. Cutting a
document greedily into longest matches, the language that needs fewest phrases wins, where the
phrases are normalised by what one phrase costs to point at: the logarithm of the language's
training length. The automata become transition tables, so that the blocks of many documents
are parsed in step in numpy; blocks are then parsed again from where the block before them ended, as
far as that changes anything, so that phrases run across them as in one pass over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import slices, table

#: Bounds of the training sample: rows a language, characters of a row that may be drawn, characters a language.
SAMPLE_ROWS, ROW_CHARS, LANGUAGE_CHARS = 64, 4096, 32768
#: Letters of a language with a symbol of their own, the most frequent ones, and symbols that all other letters share by their
#: code points; 0 stands for what is no letter.
LETTERS, SHARED = 44, 18
WIDTH = 1 + LETTERS + SHARED
#: Letters that are parsed in step as one block.
BLOCK = 256
#: Characters of a batch that are parsed at once.
SLICE = 1 << 20

_WORD = re.compile(r"[^\W\d_]")


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions ``[state, symbol]`` of the suffix automaton of ``text``; -1 where no match runs on. State 0 is the root."""
    size = 2 * len(text) + 2
    move = np.full((size, symbols), -1, np.int32)
    link, length = [-1] + [0] * size, [0] * (size + 1)
    step: list[dict[int, int]] = [{}]
    last = 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        length[now] = length[last] + 1
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p < 0:
            link[now] = 0
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length[copy] = length[p] + 1
                link[copy] = link[q]
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    for s, to in enumerate(step):
        for c, t in to.items():
            move[s, c] = t
    return move[: len(step)]


class Parser:
    """Automata of several languages, each over its own alphabet, as one table of transitions."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        """samples: texts by language; a language's text is used up to the bound ``LANGUAGE_CHARS``."""
        self.languages = sorted(samples)
        #: By code point: the letter in lower case, or 0.
        self.fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                self.fold[c] = ord(low) if len(low) == 1 else c
        tables, self.code, self.root, self.cost, at = [], [], [], [], 0
        for k in self.languages:
            text = self.encode("\n".join(samples[k])[:LANGUAGE_CHARS])
            letters, often = np.unique(text[text != 0], return_counts=True)
            code = (1 + LETTERS + np.arange(0x110000) % SHARED).astype(np.uint8)
            code[0] = 0
            top = letters[np.lexsort((letters, -often))[:LETTERS]]
            code[top] = 1 + np.arange(len(top))
            self.code.append(code)
            move = suffix_automaton(code[text], WIDTH)
            # a dead end starts the next phrase at the root; a symbol the root lacks is a phrase of its own
            start = np.where(move[0] < 0, 0, move[0])
            dead = move < 0
            move = np.where(dead, start, move) + at
            tables.append((move << 1 | dead).astype(np.int32))
            self.root.append(at)
            self.cost.append(float(np.log2(len(text) + 2)))
            at += len(move)
        self.table = np.concatenate([t.reshape(-1) for t in tables]) if tables else np.zeros(0, np.int32)

    def encode(self, text: str) -> np.ndarray:
        """The letters of a text as code points in lower case; a run of what is no letter is one 0."""
        found = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(found) > 1:
            found = found[np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]]
        return found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases ``[language, text]`` of whole encoded texts."""
        many = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), many)
        blocks = np.zeros((len(of), BLOCK), np.uint32)
        size = np.full(len(of), BLOCK, np.int64)
        at = 0
        for t, n in zip(texts, many.tolist()):
            if n:
                blocks[at : at + n].reshape(-1)[: len(t)] = t
                size[at + n - 1] = len(t) - (n - 1) * BLOCK
            at += n
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.r_[-1, place[:-1]]  # where the block before stands, -1 for a text's first
        before[(np.cumsum(many) - many)[many > 0]] = -1
        before = before[order]
        steps = np.ascontiguousarray(blocks[order].T)
        size, of = size[order], of[order]
        left = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks longer than each step
        out = np.zeros((len(self.languages), len(texts)))
        for k, root in enumerate(self.root):
            symbols = self.code[k][steps]
            state = np.full(len(of), root, np.int32)
            count = np.zeros(len(of), np.int64)
            path = np.empty((BLOCK, len(of)), np.int32)
            for i in range(BLOCK):
                n = left[i]
                if not n:
                    break
                got = self.table.take(state[:n] * WIDTH + symbols[i, :n])
                path[i, :n] = got
                count[:n] += got & 1
                state[:n] = got >> 1
            self._carried(before, size, symbols, root, path, state, count)
            out[k] = np.bincount(of, count, len(texts)) + (many > 0)
        return out

    def _carried(self, before: np.ndarray, size: np.ndarray, symbols: np.ndarray, root: int, path: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Parse blocks again from the end of the block before, in place, each until its path is the one it had."""
        begun = np.full(len(before), root, np.int32)
        later = np.flatnonzero(before >= 0)
        while True:
            live = later[state[before[later]] != begun[later]]
            if not len(live):
                return
            at = begun[live] = state[before[live]]
            for i in range(BLOCK):
                got, was = self.table.take(at * WIDTH + symbols[i, live]), path[i, live]
                path[i, live] = got
                count[live] += (got & 1) - (was & 1)
                at = got >> 1
                other, last = at != was >> 1, size[live] == i + 1
                state[live[other & last]] = at[other & last]
                live, at = live[other & ~last], at[other & ~last]
                if not len(live):
                    break

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for null, or without any letter.

        The score is one less the winner's share of the runner-up's normalised phrases, made
        steep: 0 at a tie, near 1 when the winner needs a third fewer.
        """
        asked = [i for i, t in enumerate(texts) if t and _WORD.search(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not asked or not self.languages:
            return lang, score
        cost = self.phrases([self.encode(texts[i]) for i in asked]) * np.array(self.cost)[:, None]
        best = cost.argmin(axis=0)
        low = cost.min(axis=0)
        second = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else low * 2
        sure = 1 - np.exp(-8 * (second / np.maximum(low, 1e-9) - 1))
        for i, b, s in zip(asked, best, sure):
            lang[i], score[i] = self.languages[b], float(min(1.0, max(0.0, s)))
        return lang, score


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Automata from a bounded sample of labelled rows.

    Of each language about ``SAMPLE_ROWS`` different rows are drawn by a hash of id and text, whatever their
    length, at a rate that the language's number of different rows gives; of a row of over ``ROW_CHARS``
    characters, an excerpt of so many from a place that the hash gives is used. Rows without text or
    language are passed over, repeated rows count once, null and repeated ids are like any other; an empty table gives a parser
    without languages; columns besides the three are not read. There is one automaton a language: their number is taken to be small.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(8))
    start = 1 + F.pmod(h, F.greatest(F.length(text_col) - ROW_CHARS, F.lit(0)) + 1)
    excerpt = F.substring(F.col(text_col), start.cast("int"), F.lit(ROW_CHARS))
    fit = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), excerpt.alias("text"), h.alias("h")
    )
    held = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not held:
        return Parser({})
    # a few rows more are let through than are used
    rate = F.create_map(*(x for k, n in sorted(held.items()) for x in (F.lit(k), F.lit(min(1.0, 2 * SAMPLE_ROWS / n)))))
    draw = F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    few = fit.where(draw < F.element_at(rate, F.col("lang"))).dropDuplicates(["lang", "h"])
    drawn: dict[str, list] = {}
    for r in few.collect():
        drawn.setdefault(r["lang"], []).append((r["h"] & ((1 << 40) - 1), r["h"], r["text"]))
    return Parser({k: [t for _, _, t in sorted(v)[:SAMPLE_ROWS]] for k, v in drawn.items()})


def predict(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; null ids and repeated rows stay, an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample's bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            lang, score = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, parser: Parser, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language cannot be told (null, or no letter at all).

    Texts with a letter stay, also where no language was learned. Where ``docs`` have a column
    ``lang`` of strings, the prediction stands in it for null. Repeated rows and null ids stay, other columns pass through
    whatever their names; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(parser)
    at = docs.columns.index(text_col)
    label = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            texts = b.column(at).to_pylist()
            lang = held.value.predict(texts)[0] if held.value.languages else None
            if lang and label is not None and b.column(label).null_count:
                columns = b.columns
                columns[label] = pa.array([x if x is not None else y for x, y in zip(columns[label].to_pylist(), lang)], pa.string())
                b = pa.RecordBatch.from_arrays(columns, b.schema.names)
            yield b.filter(pa.array([bool(t and _WORD.search(t)) if lang is None else lang[i] != "und" for i, t in enumerate(texts)]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the rows that no training may see: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    parser = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, parser).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
