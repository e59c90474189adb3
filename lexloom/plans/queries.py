"""The engine's queries by name, each with SQL for the same rows where SQL has one."""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import scoring as S
from lexloom.functions import text as T
from lexloom.functions import weights as w
from lexloom.operators import analyze as A
from lexloom.operators import compare as C
from lexloom.operators import features as feat
from lexloom.operators import narrative as N
from lexloom.operators import parts
from lexloom.operators import profile as P
from lexloom.operators import validation as V
from lexloom.operators import fitting, versions
from lexloom.plans import sql as Q
from lexloom.sources import lexicon as L
from lexloom.sources import texts
from lexloom.sources.shared import new_path, spread
from lexloom.sources.store import Store, rows_of
from lexloom.streaming import PartStream

DOCS, PAGES = "SELECT doc_id AS k, text FROM documents", "SELECT page_id AS k, html AS text FROM pages"
EDGE_TEXTS = (
    "<p>a</p><p>b</p>", "3 < 4 > 2", "a <!-- c --> b", "tail <b unclosed", "x <", "<1> </> <a\nb>q", "  x  \n \t\n\n y\t\tz \n",
    "a\r\nb\r\n\r\nc", "a.\u000bb\n\u000bc", " a \nb", "Don't STOP_now, it’s 3.14 café ' 'hi'", "!!!!!!!!!!!!", "...", "", "and and reason goal",
)
#: The id that :func:`doc_profiles` gives document 7.
ONE_ID = hashlib.sha256(b"7").hexdigest()


@cache
def lex() -> list[tuple[str, str, int]]:
    return L.load()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scores(feat.features(docs(spark, sf_dir), lex()))


# --- text ----------------------------------------------------------------------------------


def strip_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_markup(F.coalesce("text", F.lit(""))).alias("stripped"))


def normalize_ws(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.clean(F.col("text")).alias("clean_text"))


def tokenize_counts(spark, sf_dir):
    own = pages(spark, sf_dir).select("page_id", T.tokens(T.clean(F.col("text"))).alias("t"))
    return own.select("page_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


def stats_of(df: DataFrame, key: str) -> DataFrame:
    return T.with_stats(df).select(key, "clean_text", *feat.STATS)


def doc_stats(spark, sf_dir):
    return stats_of(docs(spark, sf_dir), "doc_id").drop("clean_text")


def clean_edge_cases(spark, sf_dir):
    """Pages, with markup and white space that breaks rules before and after their texts."""
    edge = F.element_at(F.array(*[F.lit(t) for t in EDGE_TEXTS]), F.pmod("page_id", F.lit(len(EDGE_TEXTS))).cast("int") + 1)
    own = T.with_stats(pages(spark, sf_dir).select("page_id", F.concat(edge, F.coalesce("text", F.lit("")), edge).alias("text")))
    return own.select("page_id", "clean_text", F.array_join("tokens", " ").alias("tokens"), *feat.STATS)


def stats_sql(source: str, key: str, extra: str, more: str = "") -> str:
    return rf"""WITH {more}{Q.cleaned(source)} SELECT k AS {key}{extra}, len(toks)::BIGINT AS word_count,
      CASE WHEN length(c) = length(translate(c, '.!?', '')) AND length(regexp_replace(c, '[{T.WHITE}]+', '', 'g')) > 0 THEN 1 ELSE length(c) - length(translate(c, '.!?', '')) END::BIGINT AS sentence_count,
      len(list_filter(string_split(c, chr(10) || chr(10)), lambda x: x <> ''))::BIGINT AS paragraph_count,
      CASE WHEN len(toks) > 0 THEN len(list_distinct(toks))::DOUBLE / len(toks) ELSE 0::DOUBLE END AS type_token_ratio FROM clean"""


def parts_sql(source: str, key: str, order: str) -> str:
    """Statistics of the joined texts of ``source`` (k, the order, text)."""
    more = f"rows0 AS ({source}), n0 AS (SELECT k AS nk, count(*)::BIGINT AS parts FROM rows0 GROUP BY k), "
    own = stats_sql(f"SELECT k, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY {order}) AS text FROM rows0 GROUP BY k", key, ", parts, len(list_distinct(toks))::BIGINT AS unique_words", more)
    return f"{own} JOIN n0 ON nk IS NOT DISTINCT FROM k"


def sql_text(x: str | None) -> str:
    if x is None:
        return "NULL"
    return " || ".join(Q.quoted(p) if len(p) > 1 or p >= " " else f"chr({ord(p)})" for p in _pieces(x)) or "''"


def _pieces(x: str) -> list[str]:
    out = [""]
    for ch in x:
        if ch < " ":
            out += [ch, ""]
        else:
            out[-1] += ch
    return [p for p in out if p]


#: Around a turn's text by its number's remainder: tags and blank lines that begin in one turn and end in a later one.
SPLIT = (("", ' <b title="'), ('x">', "\n\n <i"), ("", "mid"), ("dle> end. ", ""), ("\n \n", "glued<u"), (">to this", " 1 <"))
EDGE = f"CASE (page_id % {len(EDGE_TEXTS)} + {len(EDGE_TEXTS)}) % {len(EDGE_TEXTS)} {' '.join(f'WHEN {i} THEN {sql_text(t)}' for i, t in enumerate(EDGE_TEXTS))} END"
EDGES = f"SELECT page_id AS k, {EDGE} || coalesce(html, '') || {EDGE} AS text FROM pages"
SPLIT_TURNS = "SELECT conv_id AS k, turn, " + " || ".join(
    [f"CASE (turn % {len(SPLIT)} + {len(SPLIT)}) % {len(SPLIT)} {' '.join(f'WHEN {i} THEN {sql_text(x[0])}' for i, x in enumerate(SPLIT))} END", "coalesce(text, '')",
     f"CASE (turn % {len(SPLIT)} + {len(SPLIT)}) % {len(SPLIT)} {' '.join(f'WHEN {i} THEN {sql_text(x[1])}' for i, x in enumerate(SPLIT))} END"]
) + " AS text FROM conversations"
SPLIT_TEXTS = f"SELECT k, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM ({SPLIT_TURNS}) GROUP BY k"


def word_freq(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(T.tokens(T.clean(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


# --- lexicon -------------------------------------------------------------------------------


def lexicon_categories(spark, sf_dir):
    """Every category: its words and entries, those of its words that documents have, and how often they have them."""
    lexicon = L.lexicon(spark, lex())
    seen = word_freq(spark, sf_dir).join(L.hinted(lexicon, len(lex())), "word").groupBy("category").agg(F.count("*").alias("words_seen"), F.sum("n").alias("times"))
    own = lexicon.groupBy("category").agg(F.count("*").alias("words"), F.sum("mult").alias("entries")).join(seen, "category", "left")
    return own.select("category", "words", "entries", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words_seen", "times")])


def lexicon_lookup(spark, sf_dir):
    words = word_freq(spark, sf_dir).select("word")
    found = L.lookup(words, L.lexicon(spark, lex())).where(F.size("categories") > 0)
    return found.select("word", F.array_join("categories", ",").alias("categories"))


def category_counts(spark, sf_dir):
    own = feat.counted(docs(spark, sf_dir), lex())
    names = feat.category_names(lex())
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"cnt_{c}").alias("hits")) for c in names])
    return own.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*").where("hits > 0")


def category_percents(spark, sf_dir):
    own = feat.features(docs(spark, sf_dir), lex())
    return own.select("doc_id", *[c for c in own.columns if c.startswith("pct_")])


def coverage(spark, sf_dir):
    return feat.features(docs(spark, sf_dir), lex()).select("doc_id", "word_count", "coverage")


def stylometrics(spark, sf_dir):
    return feat.features(docs(spark, sf_dir), lex()).select("doc_id", "avg_word_length", "big_word_ratio")


def coverage_by_lang(spark, sf_dir):
    own = feat.counted(spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id"), lex(), "lang")
    return own.select("lang", "word_count", "covered", feat.share(F.col("covered"), F.col("word_count")).alias("coverage"))


def evidence(spark, sf_dir):
    return feat.evidence(docs(spark, sf_dir), lex())


# --- scores --------------------------------------------------------------------------------


def traits_query(names):
    return lambda spark, sf_dir: doc_scores(spark, sf_dir).select("doc_id", *names)


def schwartz_values(spark, sf_dir):
    return feat.features(docs(spark, sf_dir), lex()).select("doc_id", *[F.col(f"pct_{v}").alias(v) for v in w.VALUES])


def confidence_flag(spark, sf_dir):
    return doc_scores(spark, sf_dir).select("doc_id", "word_count", "coverage", "confidence_flag")


def ci_width(spark, sf_dir):
    return doc_scores(spark, sf_dir).select("doc_id", "ci_width")


def trait_results(spark, sf_dir):
    return P.trait_results(doc_scores(spark, sf_dir)).drop("label")


def trait_percentiles(spark, sf_dir):
    """The percentile of every score that a document has in a trait, and how many documents have it."""
    rows = P.trait_results(doc_scores(spark, sf_dir))
    return rows.groupBy("trait", "score").agg(F.min("percentile").alias("percentile"), F.count("*").alias("documents"))


def trait_labels(spark, sf_dir):
    return P.trait_results(doc_scores(spark, sf_dir)).select("doc_id", "trait", "label")


def label_boundaries(spark, sf_dir):
    """From where to where documents' scores have each label of each trait and summary variable."""
    scored = doc_scores(spark, sf_dir)
    each = [F.struct(F.lit(t).alias("name"), F.col(t).alias("score"), S.trait_label(t, F.col(t)).alias("label")) for t in w.TRAITS]
    each += [F.struct(F.lit(t).alias("name"), F.col(t).alias("score"), S.summary_label(t, F.col(t)).alias("label")) for t in w.SUMMARY]
    rows = scored.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    return rows.groupBy("name", "label").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("documents"))


def summary_labels(spark, sf_dir):
    return doc_scores(spark, sf_dir).select("doc_id", *[S.summary_label(s, F.col(s)).alias(s) for s in w.SUMMARY])


def values_ranked(spark, sf_dir):
    return P.values_ranked(feat.features(docs(spark, sf_dir), lex()))


#: First days of the lexicon's versions: one without some categories, the whole one, and one in which words count twice.
FIRST_DAYS, LEFT_OUT = ("2024-02-01", "2024-06-01", "2024-11-15"), ("article", "pronoun", "social")


def versioned_lexicon(spark, sf_dir):
    """Features by the version of the lexicon that held on each document's date; one in fifty has none."""
    rows = lex()
    own = {"v1": [r for r in rows if r[0] not in LEFT_OUT], "v2": rows, "v3": [(c, x, 2 * n) for c, x, n in rows]}
    date = F.when(F.pmod("doc_id", F.lit(50)) != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")).cast("string"))
    out = versions.features(docs(spark, sf_dir).withColumn("source_date", date), {v: (d, r) for d, (v, r) in zip(FIRST_DAYS, own.items(), strict=True)})
    return out.select("doc_id", "version", "word_count", "coverage", "pct_article", "pct_pronoun", "pct_negative_emotion")


def fitted_scores(spark, sf_dir):
    """Scores of all documents by a model that is fitted to their labels' quality."""
    feats = feat.features(docs(spark, sf_dir), lex())
    names = [c for c in feats.columns if c.startswith("pct_")]
    labelled = feats.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return P.scores(feats, {"openness": fitting.score(fitting.ridge(labelled, names, "quality"))}).select("doc_id", F.col("openness").alias("fitted"), "confidence_flag", "ci_width")


# --- comparisons ---------------------------------------------------------------------------


def trait_ranks(spark, sf_dir):
    """How each document's scores rank among those of all documents."""
    rows = P.trait_results(doc_scores(spark, sf_dir)).select("doc_id", "trait", "score")
    return C.ranked(rows, ["trait"], "score")


def group_profiles(spark, sf_dir):
    """Scores of sources, of languages, of both, and of all documents as one text each."""
    own = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    out = C.grouped(own, lex(), ["source", "lang"], [["source", "lang"], ["source"], ["lang"], []])
    return out.select("source", "lang", "level", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def source_course(spark, sf_dir):
    """Neuroticism of each source's documents one after another: the mean of the last three, and the step from the one before."""
    sources = read(spark, sf_dir, "documents").select("doc_id", "source")
    return C.courses(doc_scores(spark, sf_dir).select("doc_id", "neuroticism").join(sources, "doc_id"), "source", "doc_id", "neuroticism")


def source_changes(spark, sf_dir):
    """Where the extraversion of each source's documents changes most."""
    sources = read(spark, sf_dir, "documents").select("doc_id", "source")
    return C.changes(doc_scores(spark, sf_dir).select("doc_id", "extraversion").join(sources, "doc_id"), "source", "doc_id", "extraversion")


# --- profiles ------------------------------------------------------------------------------


def analyze_pages(spark, sf_dir):
    out = P.scores(feat.features(pages(spark, sf_dir), lex(), "page_id"))
    return out.select("page_id", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def corpus_profile(spark, sf_dir):
    """Conversations, each as one document of all its turns."""
    out = P.scores(feat.features(spread(read(spark, sf_dir, "conversations").select("conv_id", "text"), "conv_id"), lex(), "conv_id"))
    return out.select("conv_id", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def stream_profile(spark, sf_dir):
    """Conversations whose turns come in three waves, each a run of a stream that goes on from the state of the one before."""
    folder = new_path(spark, "stream")
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.timestamp_seconds(F.col("turn") * 60).alias("time"), "text", F.least(F.floor(F.col("turn") / 2), F.lit(2)).alias("wave"))
    own = PartStream(spark, f"{folder}/out", lex(), "conv_id", delay=90.0)
    for wave in range(3):
        turns.where(F.col("wave") == wave).drop("wave").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(turns.drop("wave").schema).parquet(f"{folder}/in")
        query = own.start(stream, f"{folder}/checkpoint")
        query.awaitTermination()
    return own.current().select("conv_id", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def source_profile(spark, sf_dir):
    """Sources, each as one document of all its documents: their counts are summed, no text is joined."""
    out = P.scores(feat.features(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"), lex(), "source"))
    return out.select("source", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def split_turns(spark, sf_dir):
    """Conversations whose markup goes on from turn to turn."""
    own = spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    at = F.pmod("turn", F.lit(len(SPLIT))).cast("int")
    sides = [F.element_at(F.array(*[F.lit(x[k]) for x in SPLIT]), at + 1) for k in (0, 1)]
    return own.select("conv_id", "turn", F.concat(sides[0], F.coalesce("text", F.lit("")), sides[1]).alias("text"))


def conversation_stats(spark, sf_dir):
    """Conversations, each as one text of all its turns, exactly, though no texts are joined."""
    return parts.stats(parts.parts(split_turns(spark, sf_dir), "conv_id", ["turn"]))


def conversation_profile(spark, sf_dir):
    """Scores of conversations whose markup goes on from turn to turn."""
    out = P.scores(feat.part_features(parts.parts(split_turns(spark, sf_dir), "conv_id", ["turn"]), lex()))
    return out.select("conv_id", "word_count", "coverage", "confidence_flag", "ci_width", *w.TRAITS, *w.SUMMARY)


def source_stats(spark, sf_dir):
    """Sources, each as one text of all its documents, with exact distinct words."""
    own = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return parts.stats(parts.parts(own, "source", ["doc_id"]))


def doc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with narratives, under ids that don't change."""
    return N.with_narrative(P.profiles(docs(spark, sf_dir), lex(), analysis_id=F.sha2(F.col("doc_id").cast("string"), 256)))


def narrative(spark, sf_dir):
    return doc_profiles(spark, sf_dir).select("doc_id", "narrative")


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """A new store with the profiles of all documents."""
    store = Store(spark, new_path(spark, "analyses"))
    store.save(rows_of(doc_profiles(spark, sf_dir)))
    return store


def get_profile(spark, sf_dir):
    """The profile with one id, of all that are stored, and of an id that isn't there."""
    store = stored(spark, sf_dir)
    own = store.profile(ONE_ID).unionByName(store.profile("missing"))
    trait, summary = F.col("traits")["openness"], F.col("summary")
    return own.select("analysis_id", "confidence_flag", trait["score"].alias("openness"), trait["confidence_interval"][0].alias("ci_low"), summary["clout"].alias("clout"), F.size("values").cast("long").alias("n_values"), "narrative")


def get_analysis(spark, sf_dir):
    """The row with one id, decoded, of all that are stored."""
    own = stored(spark, sf_dir).analysis(ONE_ID)
    return own.select("id", "source_type", "word_count", "dictionary_coverage", "confidence_flag", F.coalesce(F.col("features")["article"], F.lit(0.0)).alias("article"), F.col("profile.traits")["neuroticism"]["score"].alias("neuroticism"))


def save_and_get(spark, sf_dir):
    """All profiles saved to a new store, read back and decoded."""
    store = stored(spark, sf_dir)
    rows = store.decoded(store.table())
    return rows.select(
        "id", "source_type", "word_count", "dictionary_coverage", "confidence_flag",
        F.coalesce(F.col("features")["pronoun"], F.lit(0.0)).alias("pronoun"),
        F.col("profile.traits")["openness"]["score"].alias("openness"),
        F.col("profile.traits")["openness"]["percentile"].alias("openness_percentile"),
        F.col("profile.summary.clout").alias("clout"),
        F.char_length("profile.narrative").cast("long").alias("narrative_chars"),
    )


def analyze_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests, from validation to the response; rejected ones carry their reason."""
    requests = docs(spark, sf_dir).select(F.col("doc_id").alias("request_id"), "text", F.lit("paste").alias("source_type"), F.lit("2024-03-15").alias("source_date"), F.lit(None).cast("string").alias("source_url"))
    responses, rejects = A.analyze(requests, lex(), fetch=None, analysis_id=F.sha2(F.col("request_id").cast("string"), 256))
    own = responses.select("request_id", "analysis_id", "word_count", "confidence_flag", F.col("traits")["openness"]["score"].alias("openness"), F.lit(None).cast("string").alias("reject"))
    none = [F.lit(None).cast(t).alias(c) for c, t in own.dtypes[1:-1]]
    return own.unionByName(rejects.select("request_id", *none, "reject"))


def profile_pdf(spark, sf_dir):
    """Files of all profiles: how they begin, and what some of their lines say."""
    text = F.decode("pdf", "ISO-8859-1")
    found = lambda pattern: F.regexp_extract(text, pattern, 1)
    return N.pdfs(doc_profiles(spark, sf_dir)).select(
        "doc_id", F.substring("pdf", 1, 5).cast("string").alias("magic"), (F.octet_length("pdf") > 1000).alias("whole"), found(r"Confidence level: (\w+)").alias("confidence_flag"),
        found(r"\(Openness: ([0-9.]+) ").alias("openness"), found(r"\(Regulatory Focus: [0-9.]+ \\\((\w+)").alias("regulatory_label"), found(r"\(Power: ([0-9.]+)% of words").alias("power"), found(r"\(Clout: ([0-9.]+) ").alias("clout"),
    )


OWN_LEXICON = (("articles", "the", 1), ("articles", "a", 1), ("joining", "and", 2), ("joining", "the", 1), ("never seen", "zzzzzz", 1))


def own_lexicon(spark, sf_dir):
    """Features by a lexicon of the caller's."""
    own = feat.features(docs(spark, sf_dir), list(OWN_LEXICON))
    return own.select("doc_id", "coverage", "pct_articles", "pct_joining", F.col("pct_never seen").alias("pct_never_seen"))


def own_model(spark, sf_dir):
    """Scores of which a model of the caller's gives two, and the rest of the profile follows from them."""
    model = {"openness": S.clamp(F.col("pct_article") / 20), "need_for_closure": F.when(F.col("word_count") > 300, F.lit(0.9)).otherwise(F.lit(0.1))}
    scored = P.scores(feat.features(docs(spark, sf_dir), lex()), model)
    return P.trait_results(scored).where(F.col("trait").isin("openness", "need_for_closure", "neuroticism")).select("doc_id", "trait", "score", "percentile", "ci_high", "label")


def own_narrator(spark, sf_dir):
    """Responses with narratives of the caller's making."""
    requests = docs(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.concat(F.lit("as a text: "), F.coalesce("text", F.lit(""))).alias("text"), F.lit("blog").alias("source_type"), F.lit(None).cast("string").alias("source_date"), F.lit(None).cast("string").alias("source_url"))
    narrator = lambda p: p.withColumn("narrative", F.concat_ws(" ", F.lit("words:"), F.col("word_count"), F.lit("confidence:"), F.col("confidence_flag")))
    return A.analyze(requests, lex(), fetch=None, config=texts.Config(max_text_size=0), narrator=narrator)[0].select("request_id", "narrative")


def save_conflict(spark, sf_dir):
    """A store with the profiles of documents with even numbers, and the ids that a save of all documents, some of them twice, couldn't have."""
    store = Store(spark, new_path(spark, "analyses"))
    even = docs(spark, sf_dir).where("doc_id % 2 = 0")
    store.save(rows_of(N.with_narrative(P.profiles(even, lex(), analysis_id=F.sha2(F.col("doc_id").cast("string"), 256)))))
    own = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    return store.clashes(own.unionByName(own.where("doc_id % 3 = 0")).select("id"))


def url_requests(spark, sf_dir):
    """Requests for the address of every page, and for one that no page has, of which the crawled pages give the texts."""
    own = read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    crawl = own.groupBy("url").agg(F.min("text").alias("text"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("missing"), F.col("url").alias("u")), F.struct(F.lit(1).alias("missing"), F.concat("url", F.lit("?missing")).alias("u"))))
    rows = own.select("page_id", each.alias("e")).select("page_id", "e.missing", F.lit(None).cast("string").alias("text"), F.lit("url").alias("source_type"), F.lit(None).cast("string").alias("source_date"), F.col("e.u").alias("source_url"))
    got = V.validated(texts.fetched_before(rows, crawl, V.field_error().isNull()), fetched=True)
    return got.select("page_id", "missing", F.octet_length("text").cast("long").alias("bytes"), "reject")


def folder_of_benchmark(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with a text file for each item."""
    folder = new_path(spark, "texts")
    texts.write_text_files(read(spark, sf_dir, "benchmark").select(F.format_string("%012d.txt", "item_id").alias("name"), "text"), folder)
    return folder


def folder_files(spark, sf_dir):
    """A folder of text files as rows."""
    return texts.text_files(spark, folder_of_benchmark(spark, sf_dir))


def folder_document(spark, sf_dir):
    """A folder of text files as one document."""
    own = texts.joined_files(spark, folder_of_benchmark(spark, sf_dir)).withColumn("k", F.lit(0))
    return T.with_stats(own).select("files_read", F.octet_length("text").cast("long").alias("bytes"), "word_count", "paragraph_count", F.md5("clean_text").alias("clean_md5"))


def json_requests(spark, sf_dir):
    """Documents as lines of JSON, each followed by a broken one, read as requests."""
    whole = F.to_json(F.struct("text", F.lit("blog").alias("source_type"), F.lit("2024-03-15").alias("source_date")))
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.array(whole, F.concat(F.lit("{"), whole))).alias("broken", "value"))
    return V.parsed(lines, "value", "doc_id", "broken").select("doc_id", "broken", F.when(F.col("broken") == 0, F.md5("text")).alias("text_md5"), "reject")


def json_responses(spark, sf_dir):
    """Responses as lines of JSON, and what a reader of JSON finds in them."""
    lines = A.as_json(doc_profiles(spark, sf_dir), "doc_id")
    at = lambda path: F.get_json_object("value", path)
    return lines.select(
        at("$.doc_id").cast("long").alias("doc_id"), at("$.analysis_id").alias("analysis_id"), at("$.word_count").cast("long").alias("word_count"), at("$.confidence_flag").alias("confidence_flag"),
        at("$.traits.openness.score").cast("double").alias("openness"), at("$.traits.openness.confidence_interval[1]").cast("double").alias("ci_high"), at("$.values.value_power").cast("double").alias("power"), at("$.narrative").alias("narrative"),
    )


def of_kind(n: int, values: list, cast: str = "string"):
    """The value for a document's number: a column for Spark."""
    out = F.lit(values[0])
    for i, v in enumerate(values):
        out = F.when(F.pmod("doc_id", F.lit(n)) == i, F.lit(v)).otherwise(out) if i else out
    return out.cast(cast)


def kind_sql(n: int, values: list) -> str:
    return f"CASE (doc_id % {n} + {n}) % {n} {' '.join(f'WHEN {i} THEN {sql_text(v)}' for i, v in enumerate(values))} END::VARCHAR"


#: Fields of folder requests, by a document's number: types, dates and folders that pass and fail each rule.
FOLDER_REQUESTS = ((None, None, "texts"), ("", "2024-03-15", "texts"), ("podcast", "2024-3-15", "texts"), ("email", "2024-02-30", ""), ("email", None, ""), ("chat", "", None), ("file", "2024-02-29", "texts"))


def validate_folder_requests(spark, sf_dir):
    """A folder request for every document, its source below the folder where one is configured."""
    n, (kinds, dates, folders) = len(FOLDER_REQUESTS), zip(*FOLDER_REQUESTS, strict=True)
    folder = F.concat_ws("/", F.nullif(of_kind(n, folders), F.lit("")), F.when(of_kind(n, folders) != "", F.col("source")))
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("request_id"), of_kind(n, kinds).alias("source_type"), of_kind(n, dates).alias("source_date"), folder.alias("folder"))
    return V.validated_folders(rows, F.col("folder")).select("request_id", "source_type", "folder", "reject")


#: Fields of requests, by a document's number, and what becomes of its text: as it is, none, nine bytes of it or fewer, or more than the limit.
REQUESTS = (
    ("blog", "2024-03-15", None, ""), (None, None, None, ""), ("podcast", "2024-3-15", None, ""), ("url", None, None, ""), ("paste", "", "", "short"), ("paste", None, None, "none"), ("email", "2024-02-30", None, ""),
    ("url", None, "https://example.org/a", ""), ("chat", "2024-02-29", "not an address", ""), ("podcast", "2023-02-29", "nope", "short"), ("", "15.03.2024", "mailto:a@example.org", ""), ("file", None, "http:///x", ""), ("email", None, "ftp://example.org", ""),
)
#: One of so many documents is repeated until it is over the limit.
LARGE_EACH = 101


def validate_requests(spark, sf_dir):
    """A request for every document; the rules of fields and sizes that it fails."""
    n, (kinds, dates, urls, sizes) = len(REQUESTS), zip(*REQUESTS, strict=True)
    size, large = of_kind(n, sizes), F.pmod("doc_id", F.lit(LARGE_EACH)) == 7
    text = F.coalesce("text", F.lit(""))
    times = F.ceil(F.lit(V.MAX_BYTES + 1) / F.greatest(F.octet_length(text), F.lit(1))).cast("int")
    text = F.when(large, F.repeat(F.when(text == "", "x").otherwise(text), times)).when(size == "short", F.substring(text, 1, 4)).when(size == "none", F.lit(None)).otherwise(text)
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("request_id"), text.alias("text"), of_kind(n, kinds).alias("source_type"), of_kind(n, dates).alias("source_date"), of_kind(n, urls).alias("source_url"))
    return V.validated(rows).select("request_id", F.octet_length("text").cast("long").alias("bytes"), "reject")


KINDS, DATES, URLS, SIZES = (kind_sql(len(REQUESTS), list(c)) for c in zip(*REQUESTS, strict=True))
DATE_ERROR = r"CASE WHEN coalesce({0}, '') <> '' AND NOT (regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}') AND try_strptime({0}, '%Y-%m-%d') IS NOT NULL) THEN 'SourceDate: datetime' END"
VALIDATE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {KINDS} AS source_type, {DATES} AS source_date, {URLS} AS source_url, {SIZES} AS size FROM documents),
r AS (SELECT doc_id AS request_id, source_type, source_date, source_url, CASE WHEN (doc_id % {LARGE_EACH} + {LARGE_EACH}) % {LARGE_EACH} = 7 THEN greatest(strlen(t), 1) * ceil({V.MAX_BYTES + 1} / greatest(strlen(t), 1)::DOUBLE)::BIGINT WHEN size = 'short' THEN strlen(t[1:4]) WHEN size = 'none' THEN NULL ELSE strlen(t) END::BIGINT AS bytes FROM d),
e AS (SELECT *, CASE WHEN coalesce(source_type, '') = '' THEN 'SourceType: required' WHEN source_type NOT IN ({', '.join(map(Q.quoted, V.SOURCE_TYPES))}) THEN 'SourceType: oneof' END AS a,
  {DATE_ERROR.format('source_date')} AS b, CASE WHEN coalesce(source_url, '') <> '' AND NOT regexp_full_match(source_url, '[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s/]\S*') THEN 'SourceURL: url' END AS c FROM r)
SELECT request_id, bytes, coalesce(nullif(concat_ws('; ', a, b, c), ''),
  CASE WHEN source_type = 'url' AND coalesce(source_url, '') = '' THEN 'source_url is required when source_type=url' END,
  CASE WHEN coalesce(bytes, 0) < {V.LEAST_BYTES} THEN 'text must be at least 10 characters' WHEN bytes > {V.MAX_BYTES} THEN 'text exceeds max size' END) AS reject FROM e"""
FOLDER_KINDS, FOLDER_DATES, FOLDERS = (kind_sql(len(FOLDER_REQUESTS), list(c)) for c in zip(*FOLDER_REQUESTS, strict=True))
FOLDERS_SQL = f"""WITH r AS (SELECT doc_id AS i, source, {FOLDER_KINDS} AS s, {FOLDER_DATES} AS d, {FOLDERS} AS f FROM documents)
SELECT i AS request_id, coalesce(nullif(s, ''), 'file') AS source_type, CASE WHEN coalesce(f, '') = '' THEN '' ELSE concat_ws('/', f, source) END AS folder, coalesce(nullif(concat_ws('; ',
  CASE WHEN coalesce(s, '') <> '' AND s NOT IN ({', '.join(map(Q.quoted, V.SOURCE_TYPES))}) THEN 'SourceType: oneof' END, {DATE_ERROR.format('d')}), ''),
  CASE WHEN coalesce(f, '') = '' THEN 'dir_path not configured' END) AS reject FROM r"""

GROUPS = "grp AS (SELECT source, lang, grouping(source, lang)::BIGINT AS level, NULL AS k, {sums} FROM cnt JOIN documents ON doc_id = k GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())), "

SCORE_NAMES = {
    "big_five": w.BIG_FIVE_TRAITS,
    "regulatory_focus": ("regulatory_focus",),
    "need_for_cognition": ("need_for_cognition",),
    "cognitive_style": ("cognitive_style",),
    "need_for_closure": ("need_for_closure",),
    "summary_variables": tuple(w.SUMMARY),
}


def queries() -> dict:
    own = (
        strip_html, normalize_ws, tokenize_counts, doc_stats, word_freq, clean_edge_cases, lexicon_categories, lexicon_lookup, category_counts,
        category_percents, coverage, stylometrics, coverage_by_lang, evidence, schwartz_values, confidence_flag, ci_width, trait_percentiles,
        trait_results, trait_labels, label_boundaries, summary_labels, values_ranked, validate_requests, analyze_pages, corpus_profile,
        source_profile, conversation_stats, conversation_profile, source_stats, stream_profile, trait_ranks, group_profiles, source_course, source_changes, versioned_lexicon, fitted_scores, narrative, save_and_get, analyze_requests, profile_pdf, get_profile, get_analysis, url_requests, folder_files,
        folder_document, json_requests, json_responses, validate_folder_requests, own_lexicon, own_model, own_narrator, save_conflict,
    )
    return {q.__name__: q for q in own} | {name: traits_query(cols) for name, cols in SCORE_NAMES.items()}


def oracle_sql() -> dict[str, str]:
    rows = lex()
    names = feat.category_names(rows)
    scored, feats = Q.scored(rows, DOCS), Q.features(rows, DOCS)
    each_trait = lambda cols: " UNION ALL ".join(f"SELECT k AS doc_id, '{t}' AS trait, {cols(t)} FROM sc" for t in w.TRAITS)
    whole = lambda key: f"SELECT k AS {key}, n AS word_count, coverage, flag AS confidence_flag, w AS ci_width, {', '.join([*w.TRAITS, *w.SUMMARY])} FROM sc"
    words = f"WITH {Q.lexicon(rows)}, {Q.cleaned(DOCS)}, tok AS (SELECT k, unnest(toks) AS t FROM clean)"
    value_rows = ", ".join(f"{{'m': -pct_{v}, 'k': '{v}', 'd': '{d}', 'p': pct_{v}}}" for v, d in w.VALUES.items())
    return {
        "strip_html": f"SELECT page_id, {Q.strip("coalesce(html, '')")} AS stripped FROM pages",
        "normalize_ws": f"WITH {Q.cleaned(PAGES)} SELECT k AS page_id, c AS clean_text FROM clean",
        "tokenize_counts": f"WITH {Q.cleaned(PAGES)} SELECT k AS page_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct, array_to_string(toks, ' ') AS tokens FROM clean",
        "doc_stats": stats_sql(DOCS, "doc_id", ""),
        "clean_edge_cases": stats_sql(EDGES, "page_id", ", c AS clean_text, array_to_string(toks, ' ') AS tokens"),
        "word_freq": f"{words} SELECT t AS word, count(*)::BIGINT AS n FROM tok GROUP BY t",
        "lexicon_categories": f"{words}, f AS (SELECT t, count(*) AS n FROM tok GROUP BY t) SELECT category, count(*)::BIGINT AS words, sum(mult)::BIGINT AS entries, count(n)::BIGINT AS words_seen, coalesce(sum(n), 0)::BIGINT AS times FROM lex LEFT JOIN f ON t = word GROUP BY category",
        "lexicon_lookup": f"{words} SELECT t AS word, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT t FROM tok) d JOIN lex ON lex.word = t GROUP BY t",
        "category_counts": f"{words} SELECT k AS doc_id, category, sum(mult)::BIGINT AS hits FROM tok JOIN lex ON lex.word = t GROUP BY k, category",
        "category_percents": f"{feats} SELECT k AS doc_id, {', '.join(f'pct_{c}' for c in names)} FROM feat",
        "coverage": f"{feats} SELECT k AS doc_id, n AS word_count, coverage FROM feat",
        "stylometrics": f"{feats} SELECT k AS doc_id, avg_word_length, big_word_ratio FROM feat",
        "coverage_by_lang": f"{Q.features(rows, 'SELECT lang AS k, text FROM documents')} SELECT k AS lang, n AS word_count, covered, coverage FROM feat",
        "evidence": f"{words} SELECT k AS doc_id, category, t AS word, sum(mult)::BIGINT AS hits FROM tok JOIN lex ON lex.word = t GROUP BY k, category, t",
        "schwartz_values": f"{feats} SELECT k AS doc_id, {', '.join(f'pct_{v} AS {v}' for v in w.VALUES)} FROM feat",
        "confidence_flag": f"{scored} SELECT k AS doc_id, n AS word_count, coverage, flag AS confidence_flag FROM sc",
        "ci_width": f"{scored} SELECT k AS doc_id, w AS ci_width FROM sc",
        "trait_percentiles": f"{scored}, r AS ({each_trait(lambda t: f'{t} AS score, {Q.percentile(t)} AS percentile')}) SELECT trait, score, min(percentile) AS percentile, count(*)::BIGINT AS documents FROM r GROUP BY trait, score",
        "label_boundaries": f"{scored}, r AS ({' UNION ALL '.join([f"SELECT '{t}' AS name, {t} AS score, {Q.trait_label(t, t)} AS label FROM sc" for t in w.TRAITS] + [f"SELECT '{x}', {x}, {Q.summary_label(x, x)} FROM sc" for x in w.SUMMARY])}) SELECT name, label, min(score) AS least, max(score) AS most, count(*)::BIGINT AS documents FROM r GROUP BY name, label",
        "trait_results": f"{scored} {each_trait(lambda t: f'{t} AS score, {Q.percentile(t)} AS percentile, {Q.round2(f"greatest(0::DOUBLE, {t} - w)")} AS ci_low, {Q.round2(f"least(1::DOUBLE, {t} + w)")} AS ci_high')}",
        "versioned_lexicon": f"""{words}, a AS (SELECT doc_id, v FROM (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN DATE '2024-01-01' + ((doc_id % 400 + 400) % 400)::INT END AS day FROM documents) d ASOF LEFT JOIN (VALUES {', '.join(f"(DATE '{d}', 'v{i}')" for i, d in enumerate(FIRST_DAYS, 1))}) ver(first, v) ON d.day >= ver.first),
          lv AS (SELECT 'v1' AS v, * FROM lex WHERE category NOT IN ({', '.join(map(Q.quoted, LEFT_OUT))}) UNION ALL SELECT 'v2', * FROM lex UNION ALL SELECT 'v3', category, word, 2 * mult FROM lex),
          wd AS (SELECT v, word, {', '.join(f"sum(CASE WHEN category = '{c}' THEN mult ELSE 0 END) AS {c}" for c in ('article', 'pronoun', 'negative_emotion'))} FROM lv GROUP BY v, word),
          c AS (SELECT a.doc_id, a.v, count(t) AS n, count(wd.word) AS known, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in ('article', 'pronoun', 'negative_emotion'))} FROM a LEFT JOIN tok ON tok.k = a.doc_id LEFT JOIN wd ON wd.v = a.v AND wd.word = t GROUP BY a.doc_id, a.v)
          SELECT doc_id, v AS version, n::BIGINT AS word_count, CASE WHEN n > 0 THEN known::DOUBLE / n ELSE 0::DOUBLE END AS coverage, {', '.join(f'CASE WHEN n > 0 THEN {c}::DOUBLE / n * 100 ELSE 0::DOUBLE END AS pct_{c}' for c in ('article', 'pronoun', 'negative_emotion'))} FROM c""",
        "trait_ranks": f"{scored}, r AS ({each_trait(lambda t: f'{t} AS score')}) SELECT *, percent_rank() OVER (PARTITION BY trait ORDER BY score) AS percent_rank, cume_dist() OVER (PARTITION BY trait ORDER BY score) AS cume_dist FROM r",
        "group_profiles": f"{Q.scored(rows, DOCS, GROUPS.format(sums=Q.summed(rows)))} SELECT source, lang, level, n AS word_count, coverage, flag AS confidence_flag, w AS ci_width, {', '.join([*w.TRAITS, *w.SUMMARY])} FROM sc",
        "source_course": f"""{scored}, r AS (SELECT doc_id, source, neuroticism, round(neuroticism * 100)::BIGINT AS c FROM sc JOIN documents ON doc_id = k)
          SELECT doc_id, source, neuroticism, row_number() OVER o AS n, sum(c) OVER l::BIGINT / (count(c) OVER l) / 100 AS recent, (c - lag(c) OVER o) / 100 AS step FROM r
          WINDOW o AS (PARTITION BY source ORDER BY doc_id), l AS (PARTITION BY source ORDER BY doc_id ROWS 2 PRECEDING)""",
        "source_changes": f"""{scored}, r AS (SELECT doc_id, source, round(extraversion * 100)::BIGINT AS c FROM sc JOIN documents ON doc_id = k),
          s AS (SELECT *, row_number() OVER o AS m, sum(c) OVER o::BIGINT AS s, count(*) OVER (PARTITION BY source) AS n, sum(c) OVER (PARTITION BY source)::BIGINT AS t FROM r WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
          f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(n * s - m * t) DESC, m) AS best FROM s WHERE m < n AND n * s <> m * t)
          SELECT source, n, m AS change, doc_id AS last_before, s / m / 100 AS mean_before, (t - s) / (n - m) / 100 AS mean_after FROM f WHERE best = 1""",
        "trait_labels": f"{scored} {each_trait(lambda t: f'{Q.trait_label(t, t)} AS label')}",
        "summary_labels": f"{scored} SELECT k AS doc_id, {', '.join(f'{Q.summary_label(s, s)} AS {s}' for s in w.SUMMARY)} FROM sc",
        "values_ranked": f"{feats} SELECT k AS doc_id, v.k AS value, v.d AS display, v.p AS percent, r::INTEGER AS rank FROM (SELECT k, unnest(list_sort([{value_rows}])) AS v, generate_subscripts(list_sort([{value_rows}]), 1) AS r FROM feat)",
        "validate_requests": VALIDATE_SQL,
        "analyze_pages": f"{Q.scored(rows, PAGES)} {whole('page_id')}",
        "corpus_profile": f"{Q.scored(rows, "SELECT conv_id AS k, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")} {whole('conv_id')}",
        "stream_profile": f"{Q.scored(rows, "SELECT conv_id AS k, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")} {whole('conv_id')}",
        "source_profile": f"{Q.scored(rows, "SELECT source AS k, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source")} {whole('source')}",
        "conversation_stats": parts_sql(SPLIT_TURNS, "conv_id", "turn"),
        "conversation_profile": f"{Q.scored(rows, SPLIT_TEXTS)} {whole('conv_id')}",
        "source_stats": parts_sql("SELECT source AS k, doc_id, text FROM documents", "source", "doc_id"),
        "narrative": f"{scored} SELECT k AS doc_id, {Q.narrative(N.FOOTER)} AS narrative FROM sc",
        "save_and_get": f"{scored} SELECT sha256(k::VARCHAR) AS id, 'file' AS source_type, n AS word_count, coverage AS dictionary_coverage, flag AS confidence_flag, pct_pronoun AS pronoun, openness, {Q.percentile('openness')} AS openness_percentile, clout, length({Q.narrative(N.FOOTER)})::BIGINT AS narrative_chars FROM sc",
        "profile_pdf": f"{scored} SELECT k AS doc_id, '%PDF-' AS magic, true AS whole, flag AS confidence_flag, printf('%.2f', openness) AS openness, {Q.trait_label('regulatory_focus', 'regulatory_focus')} AS regulatory_label, printf('%.2f', pct_value_power) AS power, printf('%.2f', clout) AS clout FROM sc",
        "own_lexicon": f"""{Q.features(list(OWN_LEXICON), DOCS).replace('m_never seen', '"m_never seen"').replace('cnt_never seen', '"cnt_never seen"').replace('pct_never seen', 'pct_never_seen')} SELECT k AS doc_id, coverage, pct_articles, pct_joining, pct_never_seen FROM feat""",
        "own_model": f"{scored}, o AS (SELECT k, w, neuroticism, CASE WHEN pct_article / 20 > 1 THEN 1::DOUBLE ELSE {Q.round2('pct_article / 20')} END AS openness, CASE WHEN n > 300 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS need_for_closure FROM sc) {' UNION ALL '.join(f"SELECT k AS doc_id, '{t}' AS trait, {t} AS score, {Q.percentile(t)} AS percentile, {Q.round2(f'least(1::DOUBLE, {t} + w)')} AS ci_high, {Q.trait_label(t, t)} AS label FROM o" for t in ('openness', 'need_for_closure', 'neuroticism'))}",
        "own_narrator": f"{Q.scored(rows, "SELECT doc_id AS k, 'as a text: ' || coalesce(text, '') AS text FROM documents")} SELECT k AS request_id, 'words: ' || n || ' confidence: ' || flag AS narrative FROM sc",
        "save_conflict": "SELECT sha256(doc_id::VARCHAR) AS id, (1 + (doc_id % 3 = 0)::INT)::BIGINT AS times, doc_id % 2 = 0 AS known FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
        "get_profile": f"{scored} SELECT sha256(k::VARCHAR) AS analysis_id, flag AS confidence_flag, openness, {Q.round2('greatest(0::DOUBLE, openness - w)')} AS ci_low, clout, 10::BIGINT AS n_values, {Q.narrative(N.FOOTER)} AS narrative FROM sc WHERE sha256(k::VARCHAR) = '{ONE_ID}'",
        "get_analysis": f"{scored} SELECT sha256(k::VARCHAR) AS id, 'file' AS source_type, n AS word_count, coverage AS dictionary_coverage, flag AS confidence_flag, pct_article AS article, neuroticism FROM sc WHERE k = 7",
        "url_requests": rf"WITH c AS (SELECT url, min(html) AS t FROM pages GROUP BY url), r AS (SELECT page_id, m AS missing, CASE m WHEN 0 THEN url ELSE url || '?missing' END AS u FROM pages, (VALUES (0), (1)) v(m)) SELECT page_id, missing, strlen(coalesce(t, CASE WHEN c.url IS NOT NULL THEN '' END))::BIGINT AS bytes, CASE WHEN coalesce(u, '') = '' THEN 'source_url is required when source_type=url' WHEN NOT regexp_full_match(u, '[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s/]\S*') THEN 'SourceURL: url' WHEN c.url IS NULL THEN 'failed to fetch URL: not in the crawl' WHEN strlen(coalesce(t, '')) < {V.LEAST_BYTES} THEN 'text must be at least 10 characters' WHEN strlen(t) > {V.MAX_BYTES} THEN 'text exceeds max size' END AS reject FROM r LEFT JOIN c ON c.url = u",
        "folder_files": "SELECT printf('%012d.txt', item_id) AS name, coalesce(text, '') AS text FROM benchmark",
        "folder_document": f"WITH j AS (SELECT 0 AS k, count(*)::BIGINT AS files, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY item_id) AS t FROM benchmark), {Q.cleaned('SELECT k, t AS text FROM j')} SELECT files AS files_read, strlen(t)::BIGINT AS bytes, len(toks)::BIGINT AS word_count, len(list_filter(string_split(c, chr(10) || chr(10)), lambda x: x <> ''))::BIGINT AS paragraph_count, md5(c) AS clean_md5 FROM clean JOIN j USING (k)",
        "json_requests": f"SELECT doc_id, b AS broken, CASE b WHEN 0 THEN md5(text) END AS text_md5, CASE WHEN b = 1 THEN 'invalid JSON' WHEN strlen(coalesce(text, '')) < {V.LEAST_BYTES} THEN 'text must be at least 10 characters' WHEN strlen(text) > {V.MAX_BYTES} THEN 'text exceeds max size' END AS reject FROM documents, (VALUES (0), (1)) v(b)",
        "json_responses": f"{scored} SELECT k AS doc_id, sha256(k::VARCHAR) AS analysis_id, n AS word_count, flag AS confidence_flag, openness, {Q.round2('least(1::DOUBLE, openness + w)')} AS ci_high, pct_value_power AS power, {Q.narrative(N.FOOTER)} AS narrative FROM sc",
        "validate_folder_requests": FOLDERS_SQL,
        "analyze_requests": f"{scored}, r AS (SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) < {V.LEAST_BYTES} THEN 'text must be at least 10 characters' WHEN strlen(text) > {V.MAX_BYTES} THEN 'text exceeds max size' END AS reject FROM documents) SELECT doc_id AS request_id, CASE WHEN reject IS NULL THEN sha256(k::VARCHAR) END AS analysis_id, CASE WHEN reject IS NULL THEN n END AS word_count, CASE WHEN reject IS NULL THEN flag END AS confidence_flag, CASE WHEN reject IS NULL THEN openness END AS openness, reject FROM sc JOIN r ON r.doc_id = k",
        **{name: f"{scored} SELECT k AS doc_id, {', '.join(cols)} FROM sc" for name, cols in SCORE_NAMES.items()},
    }
