"""Analyzers, token filters, postings and relevance."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tarnseek.functions.analyzers import CASE_PRESERVING, ENGLISH_STOP_WORDS, FOLDED, STANDARD
from tarnseek.operators.clauses import Compare, Equals, Like, MatchAll, MatchAny, Phrase, matching
from tarnseek.operators.indexed import StoredPostings
from tarnseek.operators.postings import (
    build_postings,
    corpus_size,
    rows_with_all,
    rows_with_any,
    rows_with_glob,
    rows_with_phrase,
    score_postings,
    term_stats,
)
from tarnseek.operators.relevance import scored
from tarnseek.operators.single_pass import hits_once
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import table, view
from tarnseek.plans.search import page_with_total, search_view
from tarnseek.sources.storage import work_folder

# --- SQL for words and tokens ----------------------------------------------------
_LETTERS = r"\p{L}[\p{L}\p{M}]*"
_DIGITS = r"\p{Nd}[\p{Nd}\p{M}]*"
_PIECE = rf"{_LETTERS}(?:[.:''’·]{_LETTERS})*|{_DIGITS}(?:[.,;''’]{_DIGITS})*"
_WORD = rf"_*(?:{_PIECE})(?:{_PIECE}|_)*"
_UNSPACED = (
    r"(\p{Han}\p{M}*|\p{Hiragana}\p{M}*|[\p{Katakana}ー]+|[\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}]+)"
)


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace({text}, '{_UNSPACED}', ' \1 ', 'g'), '{_WORD}')"


def _stop_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STOP = _stop_sql(ENGLISH_STOP_WORDS)
# word(doc_id, pos, t): all words; token: without stop words; doc: token count per document
_WORD_CTE = f"""
    word AS (
        SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos
        FROM (SELECT doc_id, {_words_sql("lower(text)")} AS w FROM documents)
    ),
    token AS (SELECT * FROM word WHERE t NOT IN ({_STOP}))
"""
BM25_CTE = f"""
    {_WORD_CTE},
    doc AS (SELECT doc_id, count(*) AS dl FROM token GROUP BY doc_id),
    corpus AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM doc),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM token GROUP BY doc_id, t),
    df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
    part AS (
        SELECT tf.doc_id, tf.t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
        FROM tf JOIN df USING (t) JOIN doc USING (doc_id) CROSS JOIN corpus
    )
"""


# --- analyzers -------------------------------------------------------------------
@query(
    "tokenize_corpus",
    f"WITH {_WORD_CTE} SELECT doc_id, CAST(pos AS BIGINT) AS pos, t AS token FROM token",
)
def tokenize_corpus(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").with_tokens("text")
    placed = docs.df.select("doc_id", F.posexplode("text__tokens").alias("pos", "token"))
    return placed.where(F.col("token").isNotNull()).withColumn("pos", F.col("pos").cast("long"))


def _token_lines(name: str, analyzer, text_sql: str, stop) -> None:
    """Register each document's tokens in one line of text."""
    keep = f"t NOT IN ({_stop_sql(stop)})" if stop else "true"

    @query(
        name,
        f"""
        SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (WHERE {keep}), '') AS tokens,
               count(t) FILTER (WHERE {keep}) AS n_tokens
        FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos
              FROM (SELECT doc_id, CASE WHEN len(x) = 0 THEN [NULL] ELSE x END AS w
                    FROM (SELECT doc_id, {_words_sql(text_sql)} AS x FROM documents)))
        GROUP BY doc_id
        """,
    )
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        tokens = docs.select("doc_id", analyzer.tokens(F.col("text")).alias("found"))
        return tokens.select(
            "doc_id",
            F.array_join("found", " ").alias("tokens"),
            F.size("found").cast("long").alias("n_tokens"),
        )


_CUSTOM = ("de", "la", "el", "der", "die", "und", "le", "les", "the")
_token_lines("tokenize_case_preserving", CASE_PRESERVING, "text", ENGLISH_STOP_WORDS)
_token_lines("tokenize_custom_stopwords", STANDARD.with_stop_words(_CUSTOM), "lower(text)", _CUSTOM)
_token_lines("tokenize_no_stopwords", STANDARD.with_stop_words(()), "lower(text)", ())
_token_lines("tokenize_folded", FOLDED, "lower(strip_accents(text))", ENGLISH_STOP_WORDS)


# --- token filters ----------------------------------------------------------------
def _text_filter(name: str, where, sql: str) -> None:
    @query(name, f"WITH {_WORD_CTE} {sql}")
    def run(spark, sf_dir):
        return matching(view(spark, sf_dir, "documents"), where).df.select("doc_id", "lang")


def _docs(condition: str) -> str:
    return f"SELECT doc_id, lang FROM documents WHERE {condition}"


def _has(token: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM token WHERE t = '{token}')"


def _phrase_sql(*placed: tuple[int, str]) -> str:
    first, head = placed[0]
    joins = "".join(
        f" JOIN token w{i} ON w{i}.doc_id = w0.doc_id AND w{i}.pos = w0.pos + {p - first} AND w{i}.t = '{t}'"
        for i, (p, t) in enumerate(placed[1:], 1)
    )
    return f"SELECT DISTINCT w0.doc_id FROM token w0{joins} WHERE w0.t = '{head}'"


_text_filter("text_term", Equals("text", "from"), _docs(_has("from")))
_SHORT_FROM = Equals("text", "from") & Compare("n_chars", "<=", 500)
_text_filter(
    "text_term_is_not_analysed",
    (Equals("text", "From") & Compare("n_chars", ">", 500)) | _SHORT_FROM,
    _docs(f"{_has('from')} AND n_chars <= 500"),
)
_text_filter(
    "text_stop_word",
    (Equals("text", "of") & Compare("n_chars", ">", 500)) | _SHORT_FROM,
    _docs(f"{_has('from')} AND n_chars <= 500"),
)
_text_filter(
    "text_wildcard",
    Like("text", "thane?*le"),
    _docs("doc_id IN (SELECT doc_id FROM token WHERE regexp_matches(t, '^thane..*le$'))"),
)
_text_filter(
    "text_and_or",
    (Equals("text", "from") & Equals("lang", "en")) | Equals("text", "von") & Compare("n_chars", ">", 500),
    _docs(f"({_has('from')} AND lang = 'en') OR ({_has('von')} AND n_chars > 500)"),
)
_text_filter(
    "text_match_all", MatchAll("text", "From the HA"), _docs(f"{_has('from')} AND {_has('ha')}")
)
_text_filter("text_match_any", MatchAny("text", "Von OR the Les"), _docs(f"{_has('von')} OR {_has('les')}"))
_text_filter(
    "text_phrase",
    Phrase("text", "Anea eriner thanea"),
    _docs(f"doc_id IN ({_phrase_sql((0, 'anea'), (1, 'eriner'), (2, 'thanea'))})"),
)
_text_filter(
    "text_phrase_with_gap",
    Phrase("text", "attion to thanedble"),
    _docs(f"doc_id IN ({_phrase_sql((0, 'attion'), (2, 'thanedble'))})"),
)


@query(
    "text_filter_sort_page",
    f"""
    WITH {_WORD_CTE},
    hit AS (SELECT * FROM documents WHERE lang = 'en' AND {_has('from')})
    SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY n_chars DESC, doc_id LIMIT 15
    """,
)
def text_filter_sort_page(spark, sf_dir):
    """English documents with the token "from", longest first, page 1, with the total."""
    found = search_view(
        view(spark, sf_dir, "documents"),
        Equals("lang", "en") & Equals("text", "from"),
        select=["doc_id", "lang", "source", "n_chars"],
        order_by=["n_chars desc"],
        single_pass=True,
    )
    return page_with_total(found)


@query(
    "text_two_part_key",
    f"""
    SELECT conv_id, turn, role FROM conversations
    WHERE role = 'user' AND list_contains({_words_sql("lower(text)")}, 'from')
    """,
)
def text_two_part_key(spark, sf_dir):
    where = Equals("role", "user") & Equals("text", "from")
    return matching(view(spark, sf_dir, "conversations"), where).df.select("conv_id", "turn", "role")


@query(
    "text_folded",
    f"""
    SELECT doc_id, lang FROM (
        SELECT doc_id, lang, {_words_sql("lower(strip_accents(text))")} AS w FROM documents
    ) WHERE list_contains(w, 'fur') OR len(list_filter(w, lambda x: regexp_matches(x, '^.*tes$'))) > 0
    """,
)
def text_folded(spark, sf_dir):
    """An analyzer of one's own, whose tokens don't stand in the texts: accents are taken off both sides."""
    docs = view(spark, sf_dir, "documents")
    folded = replace(docs, spec=replace(docs.spec, analyzer=FOLDED))
    return matching(folded, MatchAny("text", "für") | Like("text", "*tes")).df.select("doc_id", "lang")


# --- postings ----------------------------------------------------------------------
_POSTINGS = f"WITH {_WORD_CTE}"


@query(
    "postings_build",
    f"""
    {_POSTINGS}, doc AS (SELECT doc_id, count(*) AS length FROM token GROUP BY doc_id)
    SELECT doc_id, t AS term, count(*) AS tf, any_value(length) AS length,
           string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
    FROM token JOIN doc USING (doc_id) GROUP BY doc_id, t
    """,
)
def postings_build(spark, sf_dir):
    postings = build_postings(view(spark, sf_dir, "documents"), "text")
    shown = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return postings.select(
        "doc_id",
        "term",
        F.col("tf").cast("long").alias("tf"),
        F.col("length").cast("long").alias("length"),
        shown.alias("positions"),
    )


@query(
    "term_stats",
    f"{_POSTINGS} SELECT t AS term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM token GROUP BY t",
)
def stats_of_terms(spark, sf_dir):
    return term_stats(build_postings(view(spark, sf_dir, "documents"), "text", positions=False))


@query("text_postings_and", f"{_POSTINGS} SELECT doc_id FROM documents WHERE {_has('from')} AND {_has('ha')} AND {_has('er')}")
def text_postings_and(spark, sf_dir):
    terms = ["from", "ha", "er"]
    postings = build_postings(view(spark, sf_dir, "documents"), "text", positions=False, terms=terms)
    return rows_with_all(postings, ["doc_id"], terms)


@query("text_postings_or", f"{_POSTINGS} SELECT doc_id FROM documents WHERE {_has('von')} OR {_has('les')}")
def text_postings_or(spark, sf_dir):
    terms = ["von", "les"]
    postings = build_postings(view(spark, sf_dir, "documents"), "text", positions=False, terms=terms)
    return rows_with_any(postings, ["doc_id"], terms)


@query(
    "text_postings_wildcard",
    f"{_POSTINGS} SELECT DISTINCT doc_id FROM token WHERE regexp_matches(t, '^.*edble$')",
)
def text_postings_wildcard(spark, sf_dir):
    postings = build_postings(view(spark, sf_dir, "documents"), "text", positions=False)
    return rows_with_glob(postings, ["doc_id"], "*edble")


@query("text_postings_phrase", f"{_POSTINGS} {_phrase_sql((0, 'attion'), (2, 'thanedble'))}")
def text_postings_phrase(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    placed = docs.spec.analyzer.analyze_literal(spark, "attion to thanedble")
    postings = build_postings(docs, "text", terms=[term for _, term in placed])
    return rows_with_phrase(postings, ["doc_id"], placed)


# --- relevance -----------------------------------------------------------------------
def _scores(name: str, where, sql: str, rounded: bool = False) -> None:
    @query(name, f"WITH {BM25_CTE} {sql}")
    def run(spark, sf_dir):
        rows, figures, _ = hits_once(view(spark, sf_dir, "documents"), where, ["doc_id"], ranked=True)
        hits = scored(rows, where, rounded, figures, matched=True)
        return hits.df.select("doc_id", F.round("_score", 6).alias("score"))


_scores("bm25_single_term", Equals("text", "from"), "SELECT doc_id, round(s, 6) AS score FROM part WHERE t = 'from'")
_scores(
    "bm25_multi_term",
    MatchAny("text", "from ha the er"),
    "SELECT doc_id, round(sum(s), 6) AS score FROM part WHERE t IN ('from', 'ha', 'er') GROUP BY doc_id",
)
_scores(
    "bm25_and_or",
    (Equals("text", "from") | Equals("text", "von")) & Equals("lang", "en") & Compare("n_chars", ">", 200),
    """
    , rarity AS (
        SELECT ln(1 + (n_lang - df_en + 0.5) / (df_en + 0.5)) AS en
        FROM (SELECT count(lang)::DOUBLE AS n_lang, count(*) FILTER (WHERE lang = 'en')::DOUBLE AS df_en FROM documents)
    )
    SELECT doc_id, round(sum(s) + any_value(en) + 1.0, 6) AS score
    FROM part JOIN documents USING (doc_id) CROSS JOIN rarity
    WHERE t IN ('from', 'von') AND lang = 'en' AND n_chars > 200 GROUP BY doc_id
    """,
)
_scores(
    "bm25_rounded_length",
    Equals("text", "from"),
    """
    , byte AS (
        SELECT doc_id, dl, CASE WHEN dl < 24 THEN dl ELSE
            24 + (dl - 24) - (dl - 24) % CAST(pow(2, greatest(length(bin(dl - 24)) - 4, 0)) AS BIGINT) END AS kept
        FROM doc
    )
    SELECT tf.doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * kept / avgdl)), 6) AS score
    FROM tf JOIN df USING (t) JOIN byte USING (doc_id) CROSS JOIN corpus WHERE t = 'from'
    """,
    rounded=True,
)


@query(
    "bm25_from_postings",
    f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM part WHERE t IN ('from', 'ha') GROUP BY doc_id",
)
def bm25_from_postings(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    size = corpus_size(docs, "text").select(F.struct("docs", "tokens").alias("size")).scalar()
    terms = ["from", "ha"]
    postings = build_postings(docs, "text", positions=False, terms=terms)
    found = score_postings(postings, ["doc_id"], terms, size["docs"], size["tokens"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "relevance_page",
    f"WITH {BM25_CTE} SELECT doc_id, lang FROM part JOIN documents USING (doc_id) "
    "WHERE t IN ('from', 'ha') GROUP BY doc_id, lang ORDER BY sum(s) DESC, doc_id LIMIT 15",
)
def relevance_page(spark, sf_dir):
    found = search_view(
        view(spark, sf_dir, "documents"), MatchAny("text", "from ha"), select=["doc_id", "lang"], single_pass=True
    )
    return found.rows


@query(
    "relevance_page_bounded",
    f"""
    WITH {BM25_CTE}, hit AS (
        SELECT doc_id, lang, sum(s) AS s FROM part JOIN documents USING (doc_id) WHERE t IN ('haon', 'en') GROUP BY doc_id, lang
    )
    SELECT doc_id, lang, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY s DESC, doc_id LIMIT 15 OFFSET 15
    """,
)
def relevance_page_bounded(spark, sf_dir):
    """A ranked page of a rare and a common word: rows with the common one alone can't reach it and are never joined or scored."""
    docs = view(spark, sf_dir, "documents")
    where = MatchAny("text", "haon en")
    index = {"text": StoredPostings(docs, "text", work_folder(spark, "postings"), terms=list(where.terms(docs)), positions=False)}
    return page_with_total(search_view(docs, where, ["doc_id", "lang"], page=2, size=15, indexes=index, score_bounds=True))


@query(
    "group_count_by_relevance",
    f"""
    WITH {BM25_CTE}
    SELECT lang, count(*) AS "count" FROM part JOIN documents USING (doc_id)
    WHERE t = 'from' GROUP BY lang ORDER BY max(s) DESC
    """,
)
def group_count_by_relevance(spark, sf_dir):
    return search_view(view(spark, sf_dir, "documents"), Equals("text", "from"), group_by="lang").rows
