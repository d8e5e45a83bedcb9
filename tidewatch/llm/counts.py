"""Token counts under a unigram model, scored once per shared prefix."""

from __future__ import annotations

import base64
import math

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import read_table
from tidewatch.session import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
TRIE_NODES = 300_000         # bound of a task's trie; a full one starts anew
KNOWN_COUNTS = 300_000       # bound of a task's table of terminal counts
BLOCK_CHARS = 1 << 20        # characters between two looks at the bounds


def load_vocabulary(path: str) -> dict[bytes, float]:
    """Log-probability of each piece of a rank file (base64 piece, rank).

    The file has ranks in place of probabilities: a piece of rank r has
    probability in proportion to 1 / (r + 1) (Zipf's rule).
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class PrefixTrie:
    """Trie of pre-tokens whose nodes hold the forward score of their prefix
    and the number of tokens on its best path; equal scores take the fewer
    tokens."""

    def __init__(self, pieces: dict[bytes, float], limit: int = TRIE_NODES):
        self.limit = limit
        # every ending of a piece, with the score of those that are pieces:
        # looking back from a position stops where no piece can end
        self.endings = dict.fromkeys((p[k:] for p in pieces for k in range(1, len(p))), -math.inf) | pieces
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, token: bytes) -> int:
        """Tokens of the best segmentation; only prefixes that no earlier
        pre-token had are scored."""
        if len(self.score) > self.limit:
            self.clear()
        child, score, tokens, endings = self.child, self.score, self.tokens, self.endings
        node, path = 0, [0]
        for end, byte in enumerate(token, 1):
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(score)
                best, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    p = endings.get(token[start:end])
                    if p is None:
                        break
                    s = p + score[path[start]]
                    if s >= best:
                        k = tokens[path[start]] + 1
                        if s > best or k < fewest:
                            best, fewest = s, k
                score.append(best)
                tokens.append(fewest)
            node = nxt
            path.append(node)
        return tokens[node]


class TerminalCounts(dict):
    """Token count of each pre-token seen, from the trie when it is new."""

    def __init__(self, trie: PrefixTrie, limit: int = KNOWN_COUNTS):
        super().__init__()
        self.trie, self.limit = trie, limit

    def __missing__(self, token: str) -> int:
        n = self.trie.count(token.encode())
        if len(token) <= 256:    # longer ones are not worth their memory
            self[token] = n
        return n

    def total(self, tokens: list[str]) -> int:
        if len(self) > self.limit:
            self.clear()
        return sum(map(self.__getitem__, tokens))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each whole text under the unigram model of a vocabulary file.

    A text is cut into pre-tokens by the public pattern of the vocabulary;
    each distinct pre-token of a task goes through the task's trie, which
    scores every prefix once. Nothing is shuffled; trie and counts have a
    fixed bound and start anew beyond it, which changes no result.

    Columns: ``id``, ``n_bytes``, ``n_pretokens``, ``n_tokens``. A null or
    empty text has zeros. Repeated rows get equal results; an empty table
    gives an empty result.
    """
    ship_package(df.sparkSession)

    def count(batches):
        find = regex.compile(public_tokenizers.PATTERN).findall
        known = TerminalCounts(PrefixTrie(load_vocabulary(public_tokenizers.path(vocabulary))))
        for b in batches:
            sizes, pre, tokens = [], [], []
            for text in b.column(1):
                text = text.as_py() or ""
                parts = find(text)
                sizes.append(len(text.encode()))
                pre.append(len(parts))
                tokens.append(sum(known.total(parts[lo:lo + BLOCK_CHARS // 8]) for lo in range(0, len(parts), BLOCK_CHARS // 8)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, pre, tokens))],
                                             ["id", "n_bytes", "n_pretokens", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_pretokens long, n_tokens long")


def op8_token_counts(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
