"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut where no vocabulary piece can reach across (before each run of word markers, and round characters outside the
vocabulary), and each piece of text is merged on its own: the lowest-rank adjacent pair is popped, its neighbours are linked
anew. The count is the number of initial symbols less the merges; no identifiers are made. Equal words are merged once per
worker: a dictionary of bounded size keeps their counts.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
#: Words whose counts a worker keeps, and the longest word that is kept.
CACHE, CACHE_CHARS = 1 << 19, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load_ranks(path: str) -> dict[str, int]:
    """piece -> rank of a byte-pair model file whose normaliser is the identity; lower ranks merge first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    order = {score: r for r, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
    ranks = {model.id_to_piece(i): order[model.get_score(i)] for i in plain}
    if any(MARK in piece.lstrip(MARK) for piece in ranks):
        raise ValueError("pieces that reach across a word marker are not supported")
    return ranks


def merged_count(word: str, ranks: dict[str, int]) -> int:
    """Tokens of one stretch of normalised text, every character of which is a piece."""
    n = total = len(word)
    get = ranks.get
    # an entry is one integer: rank, position of the left symbol and, as a check of age, the length of both together
    heap = [(r << 40) + (i << 8) + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    if not heap:
        return total
    heapify(heap)
    sizes, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        key = heappop(heap)
        i, size = (key >> 8) & 0xFFFFFFFF, key & 0xFF
        j = right[i]
        if j >= n or not sizes[i] or sizes[i] + sizes[j] != size:
            continue
        sizes[i], sizes[j] = size, 0
        total -= 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            end = k + sizes[k]
            if (r := get(word[i:end])) is not None:
                heappush(heap, (r << 40) + (i << 8) + end - i)
        h = left[i]
        if h >= 0 and (r := get(word[h : i + size])) is not None:
            heappush(heap, (r << 40) + (h << 8) + i + size - h)
    return total


class Counter(dict):
    """word -> tokens, filled as words are asked for."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks
        self.pairs = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        self.breaks = not any("\n" in pair for pair in self.pairs)  # then a new line is a token of its own
        self.words = re.compile(self.pattern()).findall

    def pattern(self) -> str:
        """Cuts a text into stretches that no merge joins: letters with the markers before them, and what stands between."""
        stop, odd = " \n" if self.breaks else " ", ""
        plain = [pair for pair in self.pairs if MARK not in pair]
        for _ in range(3):
            letter = re.compile(rf"[^\W_{re.escape(odd)}]").match
            crossing = [pair for pair in plain if bool(letter(pair[0])) != bool(letter(pair[1]))]
            if not crossing:
                odd = re.escape(odd)
                return rf" *[^\W_{odd}]+| *(?:[\W_{odd}](?<![{stop}]))+| +"
            odd += "".join(sorted({c for pair in crossing for c in pair if letter(c)}))
        return rf" *[^{stop}]+| +"

    def single(self, char: str) -> int:
        return 1 if char in self.ranks else len(char.encode("utf-8"))

    def part(self, text: str) -> int:
        if len(text) == 1:
            return self.single(text)
        found = self.get(text)
        if found is None:
            found = self.keep(text, merged_count(text, self.ranks))
        return found

    def keep(self, word: str, tokens: int) -> int:
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = tokens
        return tokens

    def __missing__(self, word: str) -> int:
        text, pairs, start, total = word.replace(" ", MARK), self.pairs, 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                total += self.part(text[start:i])
                start = i
        total += self.part(text[start:])
        return total if start else self.keep(word, total)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        breaks = text.count("\n") * self.single("\n") if self.breaks else 0
        return breaks + sum(map(self.__getitem__, self.words(text)))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat are counted each. The vocabulary (32,000 pieces, a fixed
    size) is read on the driver and broadcast; other columns are not read.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(model_path))

    def tasks(batches):
        counter = _counters.get(model_path)
        if counter is None:
            counter = _counters[model_path] = Counter(ranks.value)
        for b in batches:
            ids, sizes, tokens = b.column(0), [], []
            for s in b.column(1):
                text = s.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                tokens.append(counter.count(text))
            n = pa.array(tokens, pa.int64())
            over = pa.array([t > limit for t in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tasks, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
