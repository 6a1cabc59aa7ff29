"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct words and their beginnings (4 and 5 characters), so that inflected and unseen
forms of a stem count. For labelled texts with identity terms a second text is made in which these are
swapped for another term of their group; training adds to the logistic loss the squared change of the score
between the two, so that the terms' weights cannot stand in for the labels of the texts they occur in, and a
neutral mention of a group costs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import release, remainder, store

#: Groups of terms that may be exchanged for one another, in four languages.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "buddhistisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"),
    ("gai", "lesbienne", "hétérosexuel", "bisexuel"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"),
    ("homosexual", "lesbiana", "heterosexual"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
)
GROUP_OF = {w: group for group in IDENTITY_GROUPS for w in group}
#: Labels that the weights are fitted on at most, the ones with the least digest of their id.
SAMPLE = 24_000
FEATURES = 6000
MIN_DOCS = 4
#: Features with a smaller chi-square statistic (one degree of freedom; about 1 in 2000 by chance) are left out.
MIN_CHI = 12.0
THRESHOLD = 0.3
#: What separates words; all characters but letters and digits, by Unicode category.
_SPLIT = r"[^\p{L}\p{N}]+"


def features(word: str) -> tuple[str, ...]:
    """A word's own feature and its beginnings, marked by length."""
    if len(word) < 4:
        return (word,)
    return (word, "4" + word[:4], "5" + word[:5]) if len(word) > 4 else (word, "4" + word)


def words_of(text: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(pc.utf8_lower(text.fill_null("")), _SPLIT)


def swapped(words: set[str], salt: int) -> set[str] | None:
    """The words with each identity term exchanged for another of its group; None without any."""
    if not any(w in GROUP_OF for w in words):
        return None
    other = lambda w: [x for x in GROUP_OF[w] if x != w][(salt + len(w)) % (len(GROUP_OF[w]) - 1)]
    return {other(w) if w in GROUP_OF else w for w in words}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Labelled texts that a counterfactual was made of.
    pairs: int = 0

    def of_word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def scores(self, text: pa.Array) -> np.ndarray:
        """Probability per text; each distinct word of a text counts once."""
        lists = words_of(text)
        flat = lists.flatten().dictionary_encode()
        own = np.array([self.of_word(w) for w in flat.dictionary.to_pylist()] or [0.0])
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        heavy = own[at] != 0
        pairs = np.unique(doc[heavy] << 32 | at[heavy])
        z = self.bias + np.bincount(pairs >> 32, own[pairs & 0xFFFFFFFF], len(text))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _distinct(batches):
    release()
    for b in batches:
        lists = words_of(b.column(1))
        kept = [sorted(set(x)) for x in lists.to_pylist()]
        yield pa.record_batch([b.column(0), b.column(2), pa.array(kept, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def _featured(batches):
    """Each document's distinct features, one row each."""
    for b in batches:
        for toxic, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list({f for w in words for f in features(w)})
            yield pa.record_batch([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["feature", "toxic"])


def fit(labelled: DataFrame, penalty: float = 1.0, ridge: float = 2e-4, rounds: int = 400) -> Model:
    """labelled: doc_id, text, toxic (0 or 1).

    Features are the FEATURES with the largest chi-square, MIN_CHI at least, among those in MIN_DOCS rows or more,
    and all identity terms. Labels of one kind only give a constant score; no labels, one half. The rows come to
    the driver as places of features: pass a bounded sample.
    """
    rows = store(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_distinct, "doc_id long, toxic int, words array<string>"), "labelled")
    counted = rows.select("toxic", "words").mapInArrow(_featured, "feature string, toxic int")
    totals = {int(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model({}, float(np.log((n1 + 1) / (n0 + 1))))
    df = counted.groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    gap = F.col("a") / n1 - (F.col("n") - F.col("a")) / n0
    share = F.col("n") / (n0 + n1)
    chi = gap * gap / (share * (1 - share) + F.lit(1e-9))
    least = MIN_CHI / (n0 * n1 / (n0 + n1))
    best = df.select("feature", chi.alias("chi")).where(F.col("chi") >= least).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    names = sorted({r.feature for r in best} | set(GROUP_OF))
    index = {f: i for i, f in enumerate(names)}
    kept = docs_of(rows, index)
    return _descend(kept, index, names, penalty, ridge, rounds)


def docs_of(rows: DataFrame, index: dict[str, int]) -> list[tuple[int, list[int], list[int] | None]]:
    """The label, the features' places, and those of the counterfactual text."""
    places = rows.sparkSession.sparkContext.broadcast(index)

    def found(batches):
        at = places.value
        of = lambda words: sorted({at[f] for w in words for f in features(w) if f in at})
        for b in batches:
            out = []
            for toxic, words in zip(*(b.column(i).to_pylist() for i in (1, 2))):
                salt = zlib.crc32(" ".join(words).encode())
                other = swapped(set(words), salt)
                out.append((toxic, of(words), None if other is None else of(other), salt))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()))], names=["toxic", "own", "other", "salt"])

    sample = rows.mapInArrow(found, "toxic int, own array<int>, other array<int>, salt long").collect()
    return [(r.toxic, r.own, r.other) for r in sorted(sample, key=lambda r: (r.salt, r.toxic, r.own))]


def _descend(sample, index, names, penalty, ridge, rounds) -> Model:
    """Full-batch Adam on the regularised loss; classes are weighted alike."""
    y = np.array([t for t, _, _ in sample], float)
    row = np.repeat(np.arange(len(sample)), [len(x) for _, x, _ in sample])
    col = np.fromiter((c for _, x, _ in sample for c in x), np.int64)
    gaps = [(set(x) ^ set(o), set(x)) for _, x, o in sample if o is not None]
    gap_row = np.repeat(np.arange(len(gaps)), [len(g) for g, _ in gaps])
    gap_col = np.fromiter((c for g, _ in gaps for c in sorted(g)), np.int64)
    sign = np.fromiter((1.0 if c in own else -1.0 for g, own in gaps for c in sorted(g)), float)
    weight = np.ones(len(y)) / len(y)
    w, bias = np.zeros(len(names)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], len(y))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(col, d[row], len(w)) + ridge * w
        if len(gaps):
            change = np.bincount(gap_row, sign * w[gap_col], len(gaps))
            g += 2 * penalty / len(gaps) * np.bincount(gap_col, sign * change[gap_row], len(w))
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.02}, float(bias), len(gaps))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `_score`, 0 to 1. Null texts count as empty and get the bias alone. All columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        release()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.record_batch([*part.columns[1:], pa.array(sent.value.scores(part.column(0)))], names=[*part.schema.names[1:], "_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select(F.col("text").alias("_text"), *(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(rows, f"{kinds}, _score double")


def default_held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def judge(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column] = default_held_out, sample: int = SAMPLE) -> DataFrame:
    """docs with `_held_out` and `_score`, by a model learned from labelled rows whose doc_id is not held out.

    Learned from at most `sample` labels, those with the least digests of their ids; their texts, one for each, are
    found by a broadcast join of that bound, so that no other text is shuffled. Default held out: crc32(doc_id as text) mod 4 is
    2. Labels, lang, source and doc_id are no inputs of a score. Null doc_ids have no label; null labels are
    ignored; of several labels of a doc_id the largest counts, of several texts the least. Empty table: no rows.
    All columns stay; names beginning with an underscore are reserved.
    """
    held = lambda c: F.coalesce(held_out(c), F.lit(False))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held(F.col("doc_id")))
    some = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return score(docs.withColumn("_held_out", held(F.col("doc_id"))), fit(labelled))
