"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is normalised to words of letters and digits.  Every run of as many bigrams as a
template has is compared with it as a multiset (a text of fewer bigrams whole), so a
licence is found alone, wrapped over lines, behind comment signs, within a line, or inside a
longer file.

2 * min / (A + B) bounds the coefficient of multisets of A and B bigrams: a text must have
enough bigrams for a template's size, and a run enough of the template's bigrams, before it
is compared.  Runs that start at a bigram of the template suffice: another one holds no
more of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import arrow, chunks, split_column, table, texts, tidy, utf8
from assaykit.llm.licence_texts import TEMPLATES

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Params:
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    threshold: float = 0.8

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


class Matcher:
    """Templates by name; those of fewer than two words never match."""

    def __init__(self, p: Params) -> None:
        self.t = p.threshold
        made = {k: ws for k in sorted(p.templates) if len(ws := p.templates[k].encode().translate(FOLD).split()) > 1}
        self.names = list(made)
        self.sizes = [len(ws) - 1 for ws in made.values()]
        self.words = {w: i for i, w in enumerate(sorted({w for ws in made.values() for w in ws}))}
        grams = sorted({g for ws in made.values() for g in bigrams(ws)})
        k = len(self.words) + 1  # the last is of all other words
        #: Number of a pair of words among the templates' bigrams, or -1.
        self.gram = np.full(k * k, -1, np.int32)
        self.gram[[self.words[a] * k + self.words[b] for a, b in grams]] = np.arange(len(grams))
        #: [bigram, template] occurrences.
        self.times = np.zeros((len(grams) + 1, len(made)), np.int32)
        for j, ws in enumerate(made.values()):
            for g, n in bigrams(ws).items():
                self.times[self.gram[self.words[g[0]] * k + self.words[g[1]]], j] = n

    def find(self, texts: list[bytes]) -> list[list[tuple[int, float, str, int]]]:
        """(shared bigrams, coefficient, template, first word of the run) of every template that matches, for each text.

        Of a template's runs it is the best, the first of equals.
        """
        out: list[list[tuple[int, float, str, int]]] = [[] for _ in texts]
        words, index, offsets = split_column(pa.array([t.translate(FOLD) for t in texts], pa.large_binary()))
        if not self.names or len(index) < 2:
            return out
        get, k = self.words.get, len(self.words) + 1
        own = np.array([get(w, k - 1) for w in words.to_numpy(zero_copy_only=False).tolist()], np.int64)[index]
        gram = self.gram[own[:-1] * k + own[1:]]
        last = offsets[1:-1] - 1
        gram[last[(last >= 0) & (last < len(gram))]] = -1  # pairs over two texts
        hit = np.flatnonzero(gram >= 0)
        gram, owner = gram[hit], np.searchsorted(offsets, hit, "right") - 1
        place = hit - offsets[owner]
        size = np.maximum(np.diff(offsets) - 1, 0)  # bigrams of each text
        for j, (name, b) in enumerate(zip(self.names, self.sizes)):
            mine = np.flatnonzero(self.times[gram, j])
            doc = owner[mine]
            need = np.ceil(self.t * (np.minimum(size, b) + b) / 2 - 1e-9).astype(np.int64)[doc]
            # enough of the template's bigrams within a run's length
            end = np.arange(len(mine)) + need - 1
            ok = end < len(mine)
            end = np.where(ok, end, 0)
            ok &= (doc[end] == doc) & (place[mine][end] - place[mine] < b)
            for d in np.unique(doc[ok]).tolist():
                s, e = np.searchsorted(doc, [d, d + 1])
                got = self._best(place[mine[s:e]].tolist(), gram[mine[s:e]].tolist(), j, int(size[d]))
                if got is not None:
                    out[d].append((got[0], got[1], name, got[2]))
        return out

    def _best(self, place: list[int], gram: list[int], j: int, a: int) -> tuple[int, float, int] | None:
        b = self.sizes[j]
        a, most = min(a, b), max(a - b, 0)
        times = self.times[:, j]
        held: Counter = Counter()
        best, shared, first, last, was = (0, 0), 0, 0, 0, -1
        for p in place:
            start = min(p, most)
            if start == was:
                continue
            was = start
            while last < len(place) and place[last] < start + b:
                g = gram[last]
                held[g] += 1
                shared += held[g] <= times[g]
                last += 1
            while place[first] < start:
                g = gram[first]
                shared -= held[g] <= times[g]
                held[g] -= 1
                first += 1
            if shared > best[0]:
                best = shared, start
        if best[0] < ceil(self.t * (a + b) / 2 - 1e-9):
            return None
        return int(best[0]), float(2 * best[0] / (a + b)), best[1]


_OUT = pa.schema([("licence", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("licences", pa.string()), ("n_matches", pa.int64())])


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, licence, score, start, licences, n_matches): one row per row of ``docs``.

    A run starts at a bigram of the template, or is the text's last of its length.  licences: names of all matching templates, sorted and comma-joined (empty without one), and
    n_matches their number.  licence, score and start (the first word of the run, from 0) are
    those of the template with most shared bigrams, of equals the best score, then the first
    name; null without one.  Null and empty texts have no match.  Only doc_id and text are
    read; repeated rows are each scanned.
    """
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for b in batches:
            rows: list[tuple] = []
            for _, part in chunks(texts(b.column("_text"))):
                for found in m.find(part):
                    n, s, name, at = min(found, key=lambda x: (-x[0], -x[1], x[2]), default=(0, None, None, None))
                    rows.append((name, s, at, ",".join(sorted(x[2] for x in found)), len(found)))
            cols = list(zip(*rows)) or [()] * 5
            out = arrow(_OUT, **dict(zip(_OUT.names, cols)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.columns], names=["doc_id", *_OUT.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, licence string, score double, start long, licences string, n_matches long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_FOLDED = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP6_SQL = f"""
WITH t(name, body) AS (VALUES {_VALUES}),
tw AS (SELECT name, {_FOLDED.format("body")} AS w FROM t),
ts AS (SELECT name, len(w) - 1 AS b FROM tw),
tg AS (SELECT name, w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM tw, unnest(range(1, len(w))) AS u(i) GROUP BY ALL),
d AS (SELECT doc_id, {_FOLDED.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(w) - 1 AS a, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM d, unnest(range(1, len(w))) AS u(i)),
m AS (SELECT doc_id, name, a, b, p, g, n FROM dg JOIN tg USING (g) JOIN ts USING (name)),
held AS (SELECT doc_id, name FROM m GROUP BY doc_id, name, a, b HAVING 2 * count(*) >= 0.8 * (least(a, b) + b)),
mm AS (SELECT m.* FROM m JOIN held USING (doc_id, name)),
st AS (SELECT DISTINCT doc_id, name, least(p, greatest(a - b, 0)) AS s FROM mm),
k AS (SELECT doc_id, name, s, a, b, g, least(count(*), any_value(n)) AS k FROM st JOIN mm USING (doc_id, name) WHERE p >= s AND p < s + b GROUP BY ALL),
sc AS (SELECT doc_id, name, s, sum(k) AS shared, (2 * sum(k))::DOUBLE / (least(any_value(a), any_value(b)) + any_value(b)) AS score FROM k GROUP BY doc_id, name, s),
runs AS (SELECT doc_id, name, max(shared) AS shared, max(score) AS score, arg_min(s, struct_pack(x := -shared, y := s)) AS s FROM sc WHERE score >= 0.8 GROUP BY doc_id, name),
best AS (SELECT doc_id, arg_min(struct_pack(name, score, s), struct_pack(x := -shared, y := -score, z := name)) AS r, string_agg(name, ',' ORDER BY name) AS licences, count(*) AS n FROM runs GROUP BY doc_id)
SELECT d.doc_id, r.name AS licence, r.score AS score, r.s::BIGINT AS start, coalesce(licences, '') AS licences, coalesce(n, 0)::BIGINT AS n_matches FROM documents d LEFT JOIN best USING (doc_id)
"""
