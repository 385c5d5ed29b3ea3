"""Token counts with a whole-token shortcut (sentencepiece BPE vocabularies).

BPE merges only join neighbours whose concatenation is in the vocabulary.  A
vocabulary in which no string has the space mark after another character
therefore never merges across the start of a run of spaces: the text falls
into *pre-tokens* that are encoded independently.  The same holds around a
newline when no vocabulary string contains one.  Both facts are proved from
the vocabulary before any text is read (``prove``), and so is the set of
vocabulary strings that, standing alone as a pre-token, encode as one token.

Counting is then a dictionary lookup per pre-token.  Only pre-tokens that are
not whole tokens are merged, once per distinct string and worker, by the
library itself.  Texts are never shuffled.

Null and empty texts have no tokens and no bytes.  Other columns of the input
are ignored, so clashing names do no harm; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import small_arrow_batches, table

QUERY = "op4_token_counts"
MARK = "▁"
MAX_MEMO = 600_000  # distinct merged pre-tokens a worker remembers


@dataclass(frozen=True)
class Proof:
    """What was proved of a vocabulary: its bytes, and the pre-tokens that are
    one token, by whether the dummy space stands before them."""
    model: bytes
    newline_splits: bool
    whole: frozenset
    whole_after_newline: frozenset


def _load(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=4)
def prove(path: str) -> Proof:
    """Check the vocabulary at ``path`` and collect its whole tokens (offline)."""
    with open(path, "rb") as f:
        model = f.read()
    sp = _load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if sp.encode("a b", out_type=str) != [MARK + "a", MARK + "b"] or len(sp.encode("  ")) == 0:
        raise ValueError("not a vocabulary with a dummy space and kept white space")
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a vocabulary string crosses the start of a word")
    newline = not any("\n" in p for p in pieces)
    plain = [p for p in pieces if MARK not in p and "\n" not in p]
    spaced = [p[1:] for p in pieces if p[0] == MARK and MARK not in p[1:] and len(p) > 1
              and "\n" not in p]
    whole = frozenset(w for w, ids in zip(spaced, sp.encode(spaced, num_threads=1))
                      if len(ids) == 1)
    lead = len(sp.encode("\n"))
    after = frozenset(w for w, ids in zip(plain, sp.encode(["\n" + w for w in plain],
                                                           num_threads=1))
                      if newline and len(ids) == lead + 1)
    return Proof(model, newline, whole, after)


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, proof: Proof):
        self.sp = _load(proof.model)
        self.newline = proof.newline_splits
        self.lead = len(self.sp.encode("\n"))
        self.proof = proof
        self._reset()

    def _reset(self) -> None:
        # A pre-token after a newline is kept under a leading newline.
        self.count = dict.fromkeys(self.proof.whole, 1)
        self.count.update(("\n" + w, 1) for w in self.proof.whole_after_newline)
        self.base = len(self.count)

    def pre_tokens(self, text: str) -> list[str]:
        """Pieces that are encoded independently.  Each stands for the text of
        a run of spaces (less one) and what follows up to the next run."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words, spaces = [], 0
            for part in text.split(" "):
                if part:
                    words.append(" " * spaces + part)
                    spaces = 0
                else:
                    spaces += 1
            if spaces:  # the run that ends the text has one mark for each space
                words.append(" " * (spaces - 1) if words or spaces > 1 else "")
        else:
            words = text.split(" ")
        if not self.newline or "\n" not in text:
            return words
        cut = []
        for w in words:
            if "\n" in w:
                head, *rest = w.split("\n")
                cut.append(head)
                cut.extend("\n" + r for r in rest)
            else:
                cut.append(w)
        return cut

    def learn(self, missing: list[str]) -> None:
        """Merge pre-tokens that are not whole tokens."""
        if len(self.count) - self.base + len(missing) > MAX_MEMO:
            self._reset()
        ids = self.sp.encode(missing, num_threads=1)
        # After a newline the count leaves out the dummy space and the newline.
        self.count.update((w, len(x) - self.lead if w[:1] == "\n" else max(len(x), 1))
                          for w, x in zip(missing, ids))

    def batch(self, texts) -> list[int]:
        split, missing = [], set()
        for t in texts:
            words = self.pre_tokens(t) if t else []
            split.append(words)
            missing.update(set(words).difference(self.count))
        if missing:
            if len(self.count) - self.base + len(missing) > MAX_MEMO:
                missing = set().union(*map(set, split))
                self._reset()
                missing.difference_update(self.count)
            self.learn(sorted(missing))
        get = self.count.__getitem__
        newlines = [t.count("\n") if t and self.newline else 0 for t in texts]
        return [sum(map(get, words)) + n * (self.lead - 1)
                for words, n in zip(split, newlines)]


def token_counter(path: str):
    """A column function: text to its number of tokens."""
    proof = prove(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(proof)
        for texts in batches:
            yield pd.Series(counter.batch(texts.tolist()), dtype="int64")

    return count


def count_tokens(docs: DataFrame, text: str | Column, path: str, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of ``text`` under the vocabulary at ``path``."""
    small_arrow_batches(docs.sparkSession)
    return docs.withColumn(out, token_counter(path)(F.col(text) if isinstance(text, str) else text))


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)).alias("n_bytes"),
        "text")
    return (count_tokens(docs, "text", vocabulary())
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
