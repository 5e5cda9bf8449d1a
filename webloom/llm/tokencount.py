"""Token counts that follow edits: a segment tree over pre-token runs for each document.

A text is cut into leaves of about ``LEAF_CHARS`` characters, only at places
where the pre-tokenizer always cuts: before a space or line feed that
follows a character that isn't white space.  So the text's tokens are its
leaves' tokens.  A segment tree keeps the characters and tokens of each
subtree.

An edit (position, characters to delete, text to insert) finds its leaves
from the tree, and takes more leaves in on either side while the edge is no
longer a safe place to cut: that is the boundary context.  Only this region
is cut and encoded again, into as many leaves as it had, and the sums on
their paths to the root are updated.  A document whose region has grown
far beyond its leaves gets a new tree.

Defined results: a null text counts as empty (no tokens); positions and
lengths beyond the text are clamped to it, null ones count as 0 and a null insert as empty;
edits are applied in the order of their list; repeated rows are counted one
by one; an empty table gives no rows.  Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import small_batches
from webloom.llm.tokens import encoder

LEAF_CHARS = 256
EDITS_PER_ROUND = 1000
_CUT = re.compile(r"\S[ \n]")
EDIT = "struct<pos:long,n_del:long,ins:string>"


def _safe(text: str, at: int) -> bool:
    return at <= 0 or at >= len(text) or (not text[at - 1].isspace() and text[at] in " \n")


def _leaves(text: str, step: int) -> list[str]:
    out, at = [], 0
    while len(text) - at > step:
        m = _CUT.search(text, at + step - 1)
        if m is None:
            break
        out.append(text[at:m.start() + 1])
        at = m.start() + 1
    out.append(text[at:])
    return out


class Tree:
    """Characters and tokens of the leaves (from ``size`` on) and of the subtrees (1 is the root)."""

    def __init__(self, text: str, count):
        leaves = _leaves(text, LEAF_CHARS)
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        self.chars[self.size:self.size + len(leaves)] = [len(x) for x in leaves]
        self.tokens[self.size:self.size + len(leaves)] = [count(x) for x in leaves]
        half = self.size
        while half > 1:                                 # all parents of a level at once
            low = slice(half, 2 * half)
            half //= 2
            for sums in (self.chars, self.tokens):
                sums[half:2 * half] = sums[low].reshape(-1, 2).sum(axis=1)

    @classmethod
    def load(cls, data: bytes) -> Tree:
        out = cls.__new__(cls)
        both = np.frombuffer(data, np.int64).reshape(2, -1).copy()
        out.chars, out.tokens = both
        out.size = both.shape[1] // 2
        return out

    def dump(self) -> bytes:
        return np.stack([self.chars, self.tokens]).tobytes()

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the character at a place; the last leaf for the text's end."""
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if at - first >= self.chars[node] and self.chars[node + 1]:
                first += int(self.chars[node])
                node += 1
        return node - self.size, first

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        dc, dt = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (dc or dt):
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, text: str, pos: int, n_del: int, ins: str, count) -> tuple[str, int]:
        """(the new text, how many characters were encoded again); may need ``rebuilt`` after it."""
        pos = min(max(pos, 0), len(text))
        n_del = min(max(n_del, 0), len(text) - pos)
        new = text[:pos] + ins + text[pos + n_del:]
        if not n_del and not ins:
            return new, 0
        i, first = self.leaf_at(max(pos - 1, 0))
        j, last = self.leaf_at(pos + n_del)
        grown = len(new) - len(text)
        end = last + int(self.chars[self.size + j]) + grown
        while i > 0 and not _safe(new, first):
            i -= 1
            first -= int(self.chars[self.size + i])
        while j < self.size - 1 and not _safe(new, end):
            j += 1
            end += int(self.chars[self.size + j])
        region, slots = new[first:end], j - i + 1
        parts = _leaves(region, max(1, -(-len(region) // slots)))
        parts += [""] * (slots - len(parts))
        for k, part in enumerate(parts):
            self.set(i + k, len(part), count(part))
        return new, len(region)

    def overgrown(self, leaf_chars: int) -> bool:
        return int(self.chars[self.size:].max()) > 16 * leaf_chars


def build_trees(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_tokens, tree."""
    small_batches(docs.sparkSession)

    def run(batches):
        count = encoder(tokenizer).count
        for b in batches:
            trees = [Tree(t or "", count) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array([t.n_tokens for t in trees], pa.int64()),
                 pa.array([t.dump() for t in trees], pa.binary())], ["doc_id", "text", "n_tokens", "tree"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, text string, n_tokens long, tree binary")


def apply_edit_lists(trees: DataFrame, edits: Column, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Trees with a list of edits (an array of ``EDIT``) each; one narrow pass.

    doc_id, text, n_tokens and tree after the edits, tokens_before, n_edits, reencoded_chars.
    """
    small_batches(trees.sparkSession)

    def run(batches):
        count = encoder(tokenizer).count
        for b in batches:
            ids, texts, before, dumps, lists = (b.column(i).to_pylist() for i in range(5))
            out = [[], [], [], [], []]
            for text, data, todo in zip(texts, dumps, lists):
                tree, again = Tree.load(data), 0
                for e in todo or []:
                    text, n = tree.edit(text or "", e["pos"] or 0, e["n_del"] or 0, e["ins"] or "", count)
                    again += n
                    if n > LEAF_CHARS and tree.overgrown(LEAF_CHARS) and len(_leaves(text, LEAF_CHARS)) > tree.size:
                        tree = Tree(text, count)
                        again += len(text)
                for c, v in zip(out, (text, tree.n_tokens, tree.dump(), len(todo or []), again)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()),
                 pa.array(before, pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
                ["doc_id", "text", "n_tokens", "tree", "tokens_before", "n_edits", "reencoded_chars"])

    src = trees.select("doc_id", "text", "n_tokens", "tree", edits.cast(f"array<{EDIT}>").alias("edits"))
    schema = src.select("doc_id", "text", "n_tokens", "tree", F.lit(0).cast("long").alias("tokens_before"),
                        F.lit(0).cast("long").alias("n_edits"), F.lit(0).cast("long").alias("reencoded_chars")).schema
    return src.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits: DataFrame, per_round: int = EDITS_PER_ROUND) -> DataFrame:
    """Trees with a table of edits: doc_id, seq (0, 1, ... within the document), pos, n_del, ins.

    A round takes ``per_round`` numbers of each document, so a document with
    very many edits never has them all in one row.  Edits with equal numbers go by their other
    columns; a null seq counts as 0; edits of unknown or null ids are ignored.
    """
    seq = F.greatest(F.coalesce("seq", F.lit(0)), F.lit(0))
    turns = edits.select("doc_id", F.floor(seq / per_round).alias("turn"), F.struct(
        seq.alias("seq"), F.col("pos").cast("long").alias("pos"), F.col("n_del").cast("long").alias("n_del"),
        F.col("ins").alias("ins")).alias("e"))
    rounds = turns.agg(F.max("turn")).first()[0]
    out = trees.select("*", F.col("n_tokens").alias("_first"), F.lit(0).cast("long").alias("_n"),
                       F.lit(0).cast("long").alias("_again"))
    names = ["doc_id", "text", "n_tokens", "tree"]
    for r in range(0 if rounds is None else int(rounds) + 1):
        lists = (turns.where(F.col("turn") == r).groupBy("doc_id")
                 .agg(F.array_sort(F.collect_list("e")).alias("_edits")))
        todo = out.join(lists, "doc_id", "left")
        # Totals of earlier rounds go along in the id's place.
        keyed = todo.select(F.struct("doc_id", "_first", "_n", "_again").alias("doc_id"), *names[1:], "_edits")
        done = apply_edit_lists(keyed, F.transform("_edits", lambda e: F.struct(e["pos"], e["n_del"], e["ins"])))
        out = done.select("doc_id.doc_id", *names[1:], "doc_id._first",
                          (F.col("doc_id._n") + F.col("n_edits")).alias("_n"),
                          (F.col("doc_id._again") + F.col("reencoded_chars")).alias("_again"))
    return out.select(*names, F.col("_first").alias("tokens_before"), F.col("_n").alias("n_edits"),
                      F.col("_again").alias("reencoded_chars"))
