"""A public piece vocabulary as a unigram model, and token counts over a trie of pre-tokens.

Pieces write a space as U+2581; here they are matched with the space itself, so that a literal
U+2581 in a text is no space. A text gets one space in front, unless it is empty. A character
that no piece of its own spells may fall back to the byte pieces of its UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import slices, table

#: The vocabulary file; a parameter of every operator here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Nodes after which a task starts its trie afresh; depth of the trie, beyond which a pre-token's scores go on without nodes.
TRIE_NODES, TRIE_LENGTH = 1_200_000, 64

#: No piece goes on with a space after another character, and none holds a line feed: cuts there change no best path.
PRE_TOKEN = re.compile("[ ]+[^ \n]*|[^ \n]+|\n")


class Pieces:
    """Pieces with their scores and ids."""

    def __init__(self, model: str = MODEL) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.spelt = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelt[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                if re.search("[^ ] |\n", piece):
                    raise ValueError(f"a piece across pre-tokens: {piece!r}")
                self.scores[piece] = float(sp.get_score(i))
                self.ids[piece] = i
                self.spelt[i] = piece.encode()
        self.longest = max(map(len, self.scores))
        #: Every ending of a piece, with the piece's score or None if it is none: a walk back from a place stops early.
        self.endings: dict[str, float | None] = {p[i:]: None for p in self.scores for i in range(1, len(p))}
        self.endings.update(self.scores)
        #: Neighbours inside some piece; between others every path has a cut.
        self.joined = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - UNKNOWN_PENALTY

    def cut(self, word: str) -> list[str]:
        """``word`` in parts that no piece crosses: the best path is that of the parts, one after another."""
        joined, out, last = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[last:i])
                last = i
        out.append(word[last:])
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of the best path through one pre-token; of equal paths the one whose last pieces are longest."""
        best, back = [0.0], [(0, "")]
        for end in range(1, len(word) + 1):
            top, at = best[-1] + self.unknown, (end - 1, word[end - 1])
            if at[1] in self.scores:
                top = best[-1] + self.scores[at[1]]
            for start in range(end - 2, -1, -1):
                piece = word[start:end]
                if piece not in self.endings:
                    break
                score = self.endings[piece]
                if score is not None and best[start] + score >= top:
                    top, at = best[start] + score, (start, piece)
            best.append(top)
            back.append(at)
        out, end = [], len(word)
        while end:
            end, piece = back[end]
            out.append([self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()])
        return [i for ids in reversed(out) for i in ids]

    def decode(self, ids) -> str:
        """The text of ``ids``: what they spell, without the space in front."""
        return b"".join([self.spelt[i] for i in ids])[1:].decode("utf-8", "replace")


class Trie:
    """Forward scores and token counts of prefixes, computed once for each prefix that pre-tokens share."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of tokens of ``word``, stored at its terminal unless it ends below the trie's depth."""
        if len(self.best) > TRIE_NODES:
            self.clear()
        endings, missing = self.pieces.endings, self
        child, best, count = self.child, self.best, self.count
        node, path, end = 0, [0], 0
        for c in word if len(word) <= TRIE_LENGTH else word[:TRIE_LENGTH]:
            end += 1
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(best)
                at = path[-1]
                score = endings.get(c)
                if score is None:
                    top, n = best[at] + self.pieces.unknown, count[at] + len(c.encode())
                else:
                    top, n = best[at] + score, count[at] + 1
                start = end - 2
                while start >= 0:
                    score = endings.get(word[start:end], missing)
                    if score is missing:
                        break
                    if score is not None:
                        at = path[start]
                        score += best[at]
                        if score >= top:
                            top, n = score, count[at] + 1
                    start -= 1
                best.append(top)
                count.append(n)
            path.append(node)
        if len(word) > TRIE_LENGTH:
            return self._beyond(word, [best[x] for x in path], [count[x] for x in path])
        self.terminal[word] = count[node]
        return count[node]

    def _beyond(self, word: str, best: list[float], count: list[int]) -> int:
        """The tokens of a word deeper than the trie, from the scores and counts of its first ``TRIE_LENGTH`` places; few places are held at once."""
        endings, missing, gone = self.pieces.endings, self, 0
        for end in range(TRIE_LENGTH + 1, len(word) + 1):
            c = word[end - 1]
            score = endings.get(c)
            if score is None:
                top, n = best[-1] + self.pieces.unknown, count[-1] + len(c.encode())
            else:
                top, n = best[-1] + score, count[-1] + 1
            start = end - 2
            while start >= 0:
                score = endings.get(word[start:end], missing)
                if score is missing:
                    break
                if score is not None and score + best[start - gone] >= top:
                    top, n = score + best[start - gone], count[start - gone] + 1
                start -= 1
            best.append(top)
            count.append(n)
            if len(best) > 4096:
                gone += len(best) - self.pieces.longest
                del best[: -self.pieces.longest], count[: -self.pieces.longest]
        return count[-1]

    def tokens(self, text: str) -> tuple[int, int]:
        """Tokens and pre-tokens of a whole text."""
        if not text:
            return 0, 0
        total, words, known = 0, 0, self.terminal
        text = " " + text
        for m in PRE_TOKEN.finditer(text) if len(text) > 1 << 20 else (None,):
            found = PRE_TOKEN.findall(text) if m is None else [m.group()]
            words += len(found)
            for w in found:
                at = known.get(w)
                total += self.insert(w) if at is None else at
                known = self.terminal
        return total, words


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, n_words`` (pre-tokens) of every whole text under the unigram model of ``model``.

    Null and empty texts have none; very long texts are counted whole. Null ids and repeated rows stay, other columns are not read,
    an empty table gives no rows. A task's trie and its terminal counts are bounded.
    """
    pieces = Pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces)
        for b in slices(batches, 1):
            n, words = zip(*(trie.tokens(t.as_py()) for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "n_tokens", "n_words"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_words long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
