"""Token counts of a document's sections, from one encoding of the whole document.

The text is encoded once; the tokens' character spans are joined with the sections' spans
as intervals, both being sorted.  A token that crosses a boundary is allocated by a rule:

``majority``  to the section with most of its characters, the first of equals;
``start``     to the section with its first character;
``split``     to each section in proportion to its characters.

So counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import tokens
from assaykit.llm.common import table, tidy, utf8

RULES = ("majority", "start", "split")


@dataclass(frozen=True)
class Params:
    tokenizer: str = field(default_factory=lambda: tokens.path("byte_bpe_50k.tiktoken"))
    rule: str = "majority"

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")


def lines(text: bytes) -> np.ndarray:
    """Byte positions where sections start: every line with its line feed; a last empty one is none."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(text)]]) if text else np.zeros(0, np.int64)


def allocate(token_ends: np.ndarray, section_starts: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Tokens of each section.  Tokens and sections both cover positions 0 to ``total``.

    Tokens of no characters (parts of a character, after its first) count where they stand.
    """
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    bounds = np.append(section_starts, total)
    first = np.searchsorted(section_starts, starts, "right") - 1
    last = np.searchsorted(section_starts, np.maximum(token_ends - 1, starts), "right") - 1
    n = len(section_starts)
    out = np.bincount(first[first == last], minlength=n).astype(np.float64)
    for t in np.flatnonzero(first != last).tolist():
        own = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[own + 1], token_ends[t]) - np.maximum(bounds[own], starts[t])
        if rule == "split":
            out[own] += part / part.sum()
        else:
            out[own[int(part.argmax()) if rule == "majority" else 0]] += 1
    return out


def section_tokens(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, section, start, end, n_tokens): the lines of each row of ``docs``, in characters.

    n_tokens is a double (whole unless the rule is ``split``).  Null and empty texts have
    no sections.  Repeated rows give repeated sections; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(p.tokenizer)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("_text").to_pylist()
            for s in range(0, len(texts), 512):
                row, cols = [], ([], [], [], [])
                for i, t in enumerate(texts[s : s + 512], s):
                    if not t:
                        continue
                    t = t.decode("utf-8", "replace").encode()
                    heads = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                    starts = heads[lines(t)]
                    ends = heads[np.cumsum(bpe.sizes[bpe.encode(t)])]
                    counts = allocate(ends, starts, int(heads[-1]), p.rule)
                    row.append(np.full(len(starts), i))
                    for c, x in zip(cols, (np.arange(len(starts), dtype=np.int32), starts, np.append(starts[1:], heads[-1]), counts)):
                        c.append(x)
                if row:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(c)) for c in cols)], names=["doc_id", "section", "start", "end", "n_tokens"]
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, section int, start long, end long, n_tokens double")


def field_tokens(docs: DataFrame, fields: list[str], p: Params = Params(), separator: str = "\n") -> DataFrame:
    """(doc_id, field, n_tokens): tokens of text columns, encoded as one text joined by ``separator``.

    The separator belongs to the field before it; null fields count as empty.
    """
    ends = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(p.tokenizer)
        for b in batches:
            parts = list(zip(*(b.column(i + 1).to_pylist() for i in range(len(fields)))))
            out = []
            for own in parts:
                own = [x.decode("utf-8", "replace").encode() for x in own]
                own = [x + ends for x in own[:-1]] + own[-1:]
                t = b"".join(own)
                sizes = bpe.sizes[bpe.encode(t)]
                starts = np.cumsum([0, *map(len, own[:-1])])
                some = [i for i, x in enumerate(own) if x]
                counts = np.zeros(len(own))
                if some:
                    heads = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                    counts[some] = allocate(heads[np.cumsum(sizes)], heads[starts[some]], int(heads[-1]), p.rule)
                out.append(counts)
            row = np.repeat(np.arange(len(parts)), len(fields))
            n = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(fields * len(parts), pa.string()), pa.array(n)], names=["doc_id", "field", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = [utf8(F.col(f"`{c}`").cast("string")).alias(f"_{i}") for i, c in enumerate(fields)]
    return docs.select("doc_id", *texts).mapInArrow(tidy(run), f"doc_id {kind}, field string, n_tokens double")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
