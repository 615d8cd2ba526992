"""Pluggable models: embedders, lemmatisers, labelers, with defaults that need no download."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, mark_negation, remove_stop_words, term_tokens, with_bigrams
from lodestone.functions.vectors import unit


class Embedder(Protocol):
    """Turns a list of texts into a list of vectors; made once per worker."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = 384) -> DataFrame:
    """``df`` with feature-hashed words and neighbouring pairs as a unit vector, made in the JVM. A blank text gives zeros."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    t = with_bigrams(term_tokens(F.col(text), r"[\p{L}\p{N}\p{M}_]+"))
    hashed = HashingTF(numFeatures=dim, inputCol="_hashed_terms", outputCol="_hashed").transform(df.withColumn("_hashed_terms", t))
    return hashed.withColumn(out, unit(vector_to_array("_hashed")).cast("array<float>")).drop("_hashed_terms", "_hashed")


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], out: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with vectors of an external embedder, made once per worker and fed in batches. Newlines become spaces; null texts get null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<float>"

    def run(frames: Iterator) -> Iterator:
        model = make()
        for f in frames:
            texts = f[text]
            known = [i for i, t in enumerate(texts) if isinstance(t, str)]
            vectors: list = [None] * len(f)
            for s in range(0, len(known), batch):
                part = known[s : s + batch]
                for i, v in zip(part, model.embed([texts.iloc[i].replace("\n", " ") for i in part])):
                    vectors[i] = [float(x) for x in v]
            yield f.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def lemmatise(tokens: Column, lemmas: Mapping[str, str] | None = None) -> Column:
    """Tokens by a lemma dictionary; without one, plural and -ies endings of English words are undone by rule."""
    if lemmas is not None:
        table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv]) if lemmas else None
        return tokens if table is None else F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.transform(
        tokens,
        lambda t: F.when(t.rlike("^[a-z]{2,}ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("^[a-z]+(?:ss|us|is)$"), t).when(t.rlike("^[a-z]+(?:sh|ch|x|ss)es$"), F.regexp_replace(t, "es$", "")).when(t.rlike("^[a-z]{3,}s$"), F.regexp_replace(t, "s$", "")).otherwise(t),
    )


def lemma_string(x: Column, scope: int = 0, stop_words: Sequence[str] = STOP_WORDS, lemmas: Mapping[str, str] | None = None) -> Column:
    """Lower-case alphabetic tokens without stop words, lemmatised; ``NOT_`` marks of ``scope`` follow at the end."""
    t = term_tokens(x, r"\p{L}+")
    marks = F.filter(mark_negation(t, scope), lambda w: F.startswith(w, F.lit("NOT_")))
    return F.array_join(F.concat(lemmatise(remove_stop_words(t, stop_words), lemmas), marks), " ")


class Labeler(Protocol):
    """Names a theme from a prompt; returns the model's JSON."""

    def complete(self, prompt: str) -> str: ...


class TermsLabeler:
    """The default: a theme is named by its first terms."""

    def complete(self, prompt: str) -> str:
        terms = [t for t in prompt.split("Terms: ", 1)[-1].split("\n", 1)[0].split(", ") if t]
        return json.dumps({"theme_name": " ".join(terms[:4]).title() or "Unnamed", "theme_category": (terms[:1] or ["other"])[0], "summary": f"Reviews about {', '.join(terms[:6])}." if terms else ""})


def build_prompt(terms: Sequence[str], phrases: Sequence[str], examples: Sequence[str]) -> str:
    """What a labeler is asked: at most 10 terms, 20 phrases and 10 examples, and the three fields of the answer."""
    shown = "\n---\n".join(examples[:10])
    return f"Name the theme that these customer reviews share.\nTerms: {', '.join(terms[:10])}\nPhrases: {', '.join(phrases[:20])}\nReviews:\n{shown}\nAnswer with a JSON object with theme_name, theme_category and summary."


def label_theme(labeler: Labeler, terms: Sequence[str], phrases: Sequence[str], examples: Sequence[str]) -> dict[str, str]:
    """The labeler's answer; ``ValueError`` if it is no JSON object with the three fields."""
    said = labeler.complete(build_prompt(terms, phrases, examples))
    try:
        got = json.loads(said)
    except (TypeError, ValueError) as e:
        raise ValueError(f"the labeler's answer is no JSON: {said!r:.200}") from e
    if not isinstance(got, dict) or not {"theme_name", "theme_category", "summary"} <= got.keys():
        raise ValueError(f"the labeler's answer lacks fields: {said!r:.200}")
    return {k: got[k] for k in ("theme_name", "theme_category", "summary")}


def fit_word_vectors(df: DataFrame, words_col: str, size: int = 200, window: int = 5, min_count: int = 5, seed: int = 42):
    """Word2Vec of tokenised texts; returns the model, whose ``getVectors`` and ``findSynonyms`` serve look-ups."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol=words_col, outputCol="_w2v").fit(df)


def word_vectors(model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("embedding"))


def vocabulary_coverage(tokens: DataFrame, words_col: str, vectors: DataFrame, word: str = "word") -> DataFrame:
    """``words, known``: distinct words of the texts, and how many have a vector."""
    w = tokens.select(F.explode(words_col).alias("_w")).distinct()
    v = vectors.select(F.col(word).alias("_v")).distinct()
    return w.join(v, F.col("_w") == F.col("_v"), "left").agg(F.count(F.lit(1)).alias("words"), F.count("_v").alias("known"))
