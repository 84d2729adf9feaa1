"""Full-text search: tokens, an inverted index, boolean queries with phrases, BM25."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.snowball import stemmer
from quire.functions.stemmer import CODES, LANGUAGES
from quire.functions.stemmer import language as known_language

K1, B, EMPTY_AVERAGE = 1.2, 0.75, 256.0


def language(*names: str | None) -> str:
    """The first known of the names, most binding first; English if none is."""
    return next((x for n in names if (x := known_language(n))), "english")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def stemmed(rows: DataFrame) -> DataFrame:
    """(rel_path, words, lang) with words as their stems in the row's language, English where it is null or unknown."""

    def stems(batches):
        for batch in batches:
            words = []
            for row, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = stemmer(known_language(name) or "english")
                words.append(row if row is None else [cut(x) for x in row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), batch.column(2)], ["rel_path", "words", "lang"])

    return rows.select("rel_path", "words", "lang").mapInArrow(stems, "rel_path string, words array<string>, lang string")


def own_language(properties: Column) -> Column:
    """A note's `language` property; null where it is no text."""
    p = F.get(F.filter(properties, lambda x: (x["name"] == "language") & (x["type"] == "text")), F.lit(0))
    return F.get(p["items"], F.lit(0))["text"]


def language_of(properties: Column, *names: str | None) -> Column:
    """The language of a note's property if it is known, else the first known of the names, else English."""
    own = F.lower(F.trim(own_language(properties)))
    return F.when(own.isin(*LANGUAGES, *CODES), own).otherwise(F.lit(language(*names)))


def document_text(title: Column, body: Column) -> Column:
    """A title takes part as the body's first words, without weight of its own."""
    return F.concat_ws(" ", title, body)


@dataclass
class Index:
    """postings (term, rel_path, tf, positions) and doc_stats (rel_path, dl); an index that is made just now also has its words."""

    postings: DataFrame
    doc_stats: DataFrame
    stemming: bool = False
    words: DataFrame | None = None


def build_index(docs: DataFrame, text: Column, path: str = "rel_path", stemming: bool = False, lang: Column | None = None) -> Index:
    words = tokens(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(path).alias("rel_path"), words.alias("words"), (F.lit(None).cast("string") if lang is None else lang).alias("lang"))
    rows = stemmed(rows) if stemming else rows
    each = rows.select("rel_path", F.posexplode("words").alias("position", "term"))
    postings = each.groupBy("term", "rel_path").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    return Index(postings, rows.select("rel_path", F.size("words").alias("dl")), stemming, rows.select("rel_path", "words"))


def refreshed(index: Index, changed: Index, gone: DataFrame) -> Index:
    """The index with the changed documents' rows in place of their old ones, and without those gone (rel_path)."""
    out = gone.select("rel_path").union(changed.doc_stats.select("rel_path")).distinct()
    keep = lambda old, new: old.join(out, "rel_path", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    return Index(keep(index.postings, changed.postings), keep(index.doc_stats, changed.doc_stats), index.stemming)


@dataclass
class Query:
    """Positive clauses are lists of tokens (a phrase has several); with any OR all of them are optional."""

    positive: list[list[str]] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    optional: bool = False

    @property
    def empty(self) -> bool:
        return not self.positive

    @property
    def terms(self) -> Counter:
        return Counter(t for clause in self.positive for t in clause)


def split_words(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def parse_query(text: str, stemming: bool = False, lang: str | None = None) -> Query:
    """Terms, "phrases", -term, -"phrase", OR, AND. A negated phrase excludes each of its tokens."""
    q = Query()
    of = stemmer(language(lang)) if stemming else str
    cut = lambda s: [of(t) for t in split_words(s)]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', text):
        if word:
            if word == "OR":
                q.optional = True
            elif word != "AND":
                if word.startswith("-") and len(word) > 1:
                    q.negative += cut(word[1:])
                else:
                    q.positive += [[t] for t in cut(word)]
        elif minus:
            q.negative += cut(phrase)
        elif words := cut(phrase):
            q.positive.append(words)
    return q


def operators_only(text: str) -> bool:
    """A query of nothing but and / or."""
    words = text.split()
    return bool(words) and all(w.lower() in ("and", "or") for w in words)


def bm25(index: Index, query: Query, candidates: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(rel_path, score) of the matching documents. Corpus statistics are of the whole index, whatever the candidates.

    Only the query's own terms are read from the postings; the driver gets their counts and two sums of the corpus.
    """
    terms = query.terms
    if not terms:
        return index.doc_stats.select("rel_path", F.lit(0.0).alias("score")).limit(0)
    if index.words is not None:
        return _scanned(index.words, query, candidates, k1, b)
    corpus = index.doc_stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = corpus["n"], corpus["avgdl"] or EMPTY_AVERAGE
    wanted = index.postings.where(F.col("term").isin(*terms))
    counts = {r["term"]: r["n"] for r in wanted.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return index.doc_stats.select("rel_path", F.lit(0.0).alias("score")).limit(0)
    weight = lambda t: F.log(F.lit(1.0) + (F.lit(n - counts[t] + 0.5) / F.lit(counts[t] + 0.5))) * float(terms[t])
    idf = F.element_at(F.create_map(*(x for t in counts for x in (F.lit(t), weight(t)))), F.col("term"))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    phrases = [c for c in query.positive if len(c) > 1]
    columns = [F.sum(part).alias("score"), F.collect_set("term").alias("held")]
    if phrases:
        columns.append(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    docs = wanted.join(index.doc_stats, "rel_path").groupBy("rel_path").agg(*columns)
    if candidates is not None:
        docs = docs.join(candidates.select("rel_path").distinct(), "rel_path", "left_semi")
    has = lambda t: F.array_contains("held", t)
    for clause in query.positive:
        known = [t for t in clause if t in counts]
        everything = F.lit(bool(known))
        for t in known:
            everything = everything & has(t)
        fits = everything
        if len(clause) > 1:
            fits = everything & (_adjacent(clause) if len(known) == len(clause) else F.lit(False))
        # an optional phrase rejects documents that hold all its words apart, whatever else they match
        docs = docs.where(~everything | fits if query.optional else fits)
    if query.negative:
        docs = docs.join(index.postings.where(F.col("term").isin(*query.negative)).select("rel_path").distinct(), "rel_path", "left_anti")
    return docs.select("rel_path", "score")


def _scanned(words: DataFrame, query: Query, candidates: DataFrame | None, k1: float, b: float) -> DataFrame:
    """bm25 over (rel_path, words), without postings: one pass for the counts, one narrow pass for the scores, no shuffle.

    What a row's words say is worked out in one lambda and laid out by a generator, so that they are made once a pass.
    """
    terms = list(query.terms)
    phrases = [c for c in query.positive if len(c) > 1]

    def facts(w: Column) -> Column:
        tf = {t: F.size(F.filter(w, _equal(t))) for t in terms}
        columns = [F.size(w).alias("_dl"), *(tf[t].alias(f"_tf{i}") for i, t in enumerate(terms))]
        for i, clause in enumerate(phrases):
            places = F.sequence(F.lit(0), F.greatest(F.size(w) - len(clause), F.lit(0)))
            held = _all(F.array_contains(w, t) for t in clause)
            columns.append(F.coalesce(F.when(held, F.exists(places, _side_by_side(w, clause))), F.lit(False)).alias(f"_side{i}"))
        columns.append((F.arrays_overlap(w, F.array(*map(F.lit, query.negative))) if query.negative else F.lit(False)).alias("_no"))
        return F.struct(*columns)

    rows = words.select("rel_path", F.inline(F.transform(F.array("words"), facts)))
    row = rows.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    n, avgdl = row["n"], row["avgdl"] or EMPTY_AVERAGE
    counts = {t: row[f"df{i}"] for i, t in enumerate(terms) if row[f"df{i}"]}
    if not counts:
        return words.select("rel_path", F.lit(0.0).alias("score")).limit(0)
    names = {t: F.col(f"_tf{i}") for i, t in enumerate(terms) if t in counts}
    docs = rows.where(~F.col("_no") & _any(c > 0 for c in names.values()))
    if candidates is not None:
        docs = docs.join(candidates.select("rel_path").distinct(), "rel_path", "left_semi")
    score = F.lit(0.0)
    for t, c in names.items():
        idf = F.log(F.lit(1.0) + (F.lit(n - counts[t] + 0.5) / F.lit(counts[t] + 0.5))) * float(query.terms[t])
        score = score + idf * (c * (k1 + 1)) / (c + k1 * (1 - b + b * F.col("_dl") / avgdl))
    for clause in query.positive:
        known = [t for t in clause if t in counts]
        everything = _all(names[t] > 0 for t in known) if known else F.lit(False)
        fits = everything
        if len(clause) > 1:
            fits = everything & (F.col(f"_side{phrases.index(clause)}") if len(known) == len(clause) else F.lit(False))
        docs = docs.where(~everything | fits if query.optional else fits)
    return docs.select("rel_path", score.alias("score"))


def _equal(t: str):
    return lambda x: x == t


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _side_by_side(words: Column, clause: list[str]):
    return lambda i: _all(F.get(words, i + k) == t for k, t in enumerate(clause))


def _adjacent(clause: list[str]) -> Column:
    """Some place of the first word has the others right behind it."""
    follow = lambda p: _all(F.array_contains(F.element_at("at", t), p + i) for i, t in enumerate(clause) if i)
    return F.coalesce(F.exists(F.element_at("at", clause[0]), follow), F.lit(False))


def _all(tests):
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def low_discrimination(scores: DataFrame, documents: int) -> bool:
    """More than four in five documents match, and none well."""
    row = scores.agg(F.count("*").alias("n"), F.max("score").alias("best")).first()
    return bool(row["n"]) and row["n"] > 0.8 * documents and row["best"] < 1
