"""Queries over the driver's tables. Corpora are the languages of documents; words are Latin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN, SearchConfig, UNIGRAM_SEARCH, WordlistConfig
from ..functions import text as T
from ..functions.tokens import segments, tokenize, with_boundaries
from ..operators import evaluation, frequency, lattice, model, ngrams, review, variants, wordlist
from ..sources import readers, sinks
from ..store import cut, new_path

CORPORA = ["de", "en", "es", "fr"]
WEIGHTS = {"de": 1.0, "en": 2.0, "es": 1.0, "fr": 1.0}
MIN_COUNT = 5
CONFIG = WordlistConfig(min_source_count=2, min_frequency=5e-6, exempt_source="en")
OVERRIDES = [("the", ["da", "the", "thee"]), ("lexmillword", ["lexmil", "lexmill"])]
EXCLUDED = ["that", "and", "the"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), "doc_id", "text")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.word_counts(corpus(spark, sf_dir), LATIN)


def merged(spark: SparkSession, sf_dir: str, weights: dict | None = None) -> DataFrame:
    """The merged word list, stored, as most that follows reads it more than once."""
    return cut(frequency.merged(frequency.normalized(cut(counts(spark, sf_dir), "counts")), CORPORA, weights), "merged")


def measured(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (1, 2, 3), digits: int | None = None) -> DataFrame:
    """All n-grams with their counts, frequencies and sources, from one shuffle."""
    return ngrams.text_measured(corpus(spark, sf_dir), LATIN, CORPORA, sizes, digits=digits)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("corpus", "doc_id", with_boundaries(F.col("text"), LATIN).alias("tokens"))


def grams(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return ngrams.text_counts(corpus(spark, sf_dir), LATIN, sizes)


def spelled(words: DataFrame) -> DataFrame:
    """(word, romanizations): three regular spellings of a Latin word, in place of a lexicon's."""
    w = F.col("word")
    every = F.array(w, F.regexp_replace(w, "[aeiou]", ""), F.replace(F.replace(w, F.lit("th"), F.lit("t")), F.lit("ch"), F.lit("c")))
    return words.select("word", F.array_sort(F.array_distinct(F.filter(every, lambda x: x != ""))).alias("romanizations"))


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "word string, romanizations array<string>")


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in EXCLUDED], "word string")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with overrides and exclusions."""
    m = merged(spark, sf_dir)
    return wordlist.without_excluded(wordlist.with_overrides(m, spelled(m), overrides(spark)), exclusions(spark))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlist.filtered(listed(spark, sf_dir), CONFIG, LATIN).withColumnRenamed("freq", "frequency")


def joined(c: str) -> F.Column:
    return F.array_join(c, "|").alias(c)


# ---- counts and frequencies


def q_word_counts(s, d):
    return counts(s, d)


def q_word_freq_normalized(s, d):
    return frequency.normalized(cut(counts(s, d), "counts"))


def q_word_freq_merged(s, d):
    return merged(s, d).select("word", F.round("freq", 12).alias("freq"))


def q_word_freq_merged_weighted(s, d):
    return merged(s, d, WEIGHTS).select("word", F.round("freq", 12).alias("freq"))


def q_word_provenance(s, d):
    return merged(s, d).select("word", F.size("sources").alias("n_sources"), joined("sources"))


def q_wordlist_ranked(s, d):
    return frequency.wordlist(merged(s, d).withColumn("freq", F.round("freq", 12))).select(F.col("rank").cast("long"), "word", "frequency", "source_count", "sources")


def q_topk_words_with_ranks(s, d):
    freqs = frequency.normalized(cut(counts(s, d), "counts"))
    m = cut(frequency.merged(freqs, CORPORA), "merged")
    return frequency.top_with_ranks(m.withColumn("freq", F.round("freq", 12)), freqs, CORPORA, 500)


def q_source_word_stats(s, d):
    return frequency.source_stats(merged(s, d))


def q_token_validity_flags(s, d):
    every = corpus(s, d).select(F.explode(tokenize(F.col("text"), LATIN)).alias("token")).distinct()
    return every.select("token", *[c.alias(n) for n, c in T.validity(F.col("token"), LATIN).items()], T.is_valid(F.col("token"), LATIN).alias("valid"))


def q_token_segments(s, d):
    return segments(tokens(s, d)).select("corpus", "doc_id", "pos", "seg_id", "token")


# ---- n-grams and the model


def q_ngram1_counts(s, d):
    return grams(s, d, (1,)).select("corpus", "w1", "cnt")


def q_ngram2_counts(s, d):
    return grams(s, d, (2,)).select("corpus", "w1", "w2", "cnt")


def q_ngram3_counts(s, d):
    return grams(s, d, (3,)).select("corpus", "w1", "w2", "w3", "cnt")


def q_ngram_raw_merged(s, d):
    """From counts of n-grams in the corpora alone: neither totals nor frequencies are made."""
    return ngrams.text_raw(corpus(s, d), LATIN, CORPORA).select("n", *ngrams.GRAM, "cnt")


def q_ngram_norm_merged(s, d):
    return measured(s, d, digits=12).select("n", *ngrams.GRAM, "freq")


def q_ngrams_vocab_filtered(s, d):
    top = counts(s, d).groupBy("word").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "word").limit(1000)
    return ngrams.text_counts(corpus(s, d), LATIN, (2,), top).select("corpus", "w1", "w2", "cnt")


def q_token_source_counts(s, d):
    return ngrams.token_sources(grams(s, d, (1,))).select("word", "n_sources")


def q_valid_tokens(s, d):
    return ngrams.text_model(corpus(s, d), LATIN, CORPORA, 1, MIN_COUNT)[0].select("word", "n_sources", F.round("freq", 12).alias("freq"))


def survivors(s, d, n):
    return ngrams.text_model(corpus(s, d), LATIN, CORPORA, n, MIN_COUNT)[1].filter(F.col("n") == n)


def q_surviving_bigrams(s, d):
    return survivors(s, d, 2).select("w1", "w2", "cnt")


def q_surviving_trigrams(s, d):
    return survivors(s, d, 3).select("w1", "w2", "w3", "cnt")


def scores(s, d, most=3, inside=None):
    """Score tables of sizes up to most; with inside (word), bigrams and trigrams of its words only."""
    v, g = ngrams.text_model(corpus(s, d), LATIN, CORPORA, most, MIN_COUNT, inside)
    freqs = g.filter("n > 1").unionByName(v.select(F.lit(1).alias("n"), F.col("word").alias("w1"), "freq"), allowMissingColumns=True)
    found = [model.unigram_scores(v)]
    if most > 1:
        found.append(model.bigram_scores(g.filter("n = 2"), freqs))
    if most > 2:
        found.append(model.trigram_scores(g.filter("n = 3"), freqs))
    return found


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


def q_lm_unigram_scores(s, d):
    return rounded(scores(s, d, 1)[0], "score")


def q_lm_bigram_scores(s, d):
    return rounded(scores(s, d, 2)[1], "score")


def q_lm_trigram_scores(s, d):
    return rounded(scores(s, d)[2], "score")


def q_sbo_backoff_lookup(s, d):
    b = read(s, d, "benchmark").select(F.lit("q").alias("corpus"), with_boundaries(F.col("text"), LATIN).alias("tokens"))
    q = ngrams.explode_grams(b, (3,)).select(F.col("w1").alias("prev2"), F.col("w2").alias("prev1"), F.col("w3").alias("word")).distinct()
    q = cut(q, "asked")
    asked = q.select(F.explode(F.array("prev2", "prev1", "word")).alias("word"))
    return model.lookup(q, *[cut(x, "scores") for x in scores(s, d, inside=asked)]).select("prev2", "prev1", "word", F.round("prob", 12).alias("prob"))


# ---- cleaning


def q_clean_wikitext_pages(s, d):
    wiki = F.concat(F.lit("<!-- x -->== H ==\n* '''B''' [[A|b]] [[C]] {{t|{{u}}}}<ref>r</ref>\n"), F.col("html"))
    return read(s, d, "pages").select("page_id", T.clean_wikitext(wiki).alias("text"))


def q_html_tag_strip(s, d):
    return read(s, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


# ---- word list


def q_compound_decompose(s, d):
    return wordlist.decompositions(merged(s, d).select("word")).select("word", joined("parts"))


def q_wordlist_redistributed(s, d):
    m = merged(s, d)
    return wordlist.redistributed(m, cut(wordlist.decompositions(m.select("word")), "parts")).select("word", F.round("freq", 12).alias("freq"), joined("sources"))


def q_overrides_upsert(s, d):
    m = merged(s, d)
    return wordlist.with_overrides(m, spelled(m), overrides(s)).select("word", F.round("freq", 12).alias("freq"), joined("sources"), joined("romanizations"), "overridden")


def q_exclusion_antijoin(s, d):
    return listed(s, d).select("word", "overridden")


def q_dataset_filter_reasons(s, d):
    return wordlist.removal_reasons(listed(s, d), CONFIG, LATIN).groupBy("removed_reason").agg(F.count("*").alias("n"))


def q_dataset_filtered(s, d):
    return entries(s, d).select("word", F.round("frequency", 12).alias("frequency"), "overridden")


def q_vocab_limit(s, d):
    e = listed(s, d).withColumn("freq", F.round("freq", 12))
    return wordlist.limited(e, 100).select("word", "overridden")


def identified(s, d):
    return wordlist.with_ids(entries(s, d).withColumn("freq", F.round("frequency", 12)))


def q_trie_dataset_entries(s, d):
    return identified(s, d).select("word_id", "word", "frequency", joined("sources"), joined("romanizations"))


def q_trie_flat_keys(s, d):
    return wordlist.flat_keys(identified(s, d))


def q_key_collisions(s, d):
    return wordlist.collisions(listed(s, d))


def q_collision_histogram(s, d):
    return wordlist.collision_histogram(listed(s, d))


def q_source_coverage(s, d):
    return wordlist.source_coverage(listed(s, d))


def q_coverage_by_source_count(s, d):
    return wordlist.coverage_by_source_count(listed(s, d))


def q_variant_stats(s, d):
    return rounded(wordlist.variant_stats(listed(s, d)), "avg_variants")


def q_variant_buckets(s, d):
    return wordlist.variant_buckets(listed(s, d))


# ---- review and heuristics


def q_review_filter(s, d):
    return review.filtered(entries(s, d), source="en", sources_min=2, variants_min=2, search="TH").select("word")


def q_review_page(s, d):
    return review.page(entries(s, d).withColumn("frequency", F.round("frequency", 12)), 20, 30).select("word", "frequency")


def heuristic(s, d, name):
    e = listed(s, d).withColumn("frequency", F.round("freq", 12))
    return review.heuristics(e, LATIN)[name]


def q_heuristic_h1(s, d):
    return heuristic(s, d, "h1")


def q_heuristic_h2(s, d):
    return heuristic(s, d, "h2")


def q_heuristic_h3(s, d):
    return heuristic(s, d, "h3")


def q_heuristic_h4(s, d):
    return heuristic(s, d, "h4")


def q_classify_words(s, d):
    e = identified(s, d)
    w = e.select("word", F.element_at("romanizations", -1).alias("romanization"), (F.size("romanizations") * 4).alias("variant_count"), (F.col("word_id") + 1).alias("rank"), T.nuclei(F.col("word"), LATIN).alias("syllable_count"))
    ambiguous = s.createDataFrame([("the",), ("es",), ("en",), ("de",)], "word string")
    return review.classified(w, ambiguous).select("word", "category", "difficulty")


def q_benchmark_export(s, d):
    e = identified(s, d).withColumn("category", F.when(F.length("word") > 6, "compound").otherwise("common")).withColumn("difficulty", F.when(F.length("word") > 8, "hard").when(F.length("word") > 4, "medium").otherwise("easy"))
    status = F.when(F.col("word_id") % 3 == 0, "approved").when(F.col("word_id") % 3 == 1, "discarded").otherwise("edited")
    return review.exported(e.withColumn("review_status", status).withColumnRenamed("romanizations", "variants"))


def q_llm_batches(s, d):
    return review.batches(merged(s, d).withColumn("freq", F.round("freq", 12)), 100, 1000).select(F.col("batch").cast("long"), F.size("words").alias("n"), joined("words"))


def q_llm_parse(s, d):
    b = review.batches(merged(s, d).withColumn("freq", F.round("freq", 12)), 100, 1000)
    answer = F.concat(F.lit("Here:\n```text\n"), F.array_join(F.slice("words", 1, 3), " \n "), F.lit("\nnot-a-word\n```\nDone."))
    return review.candidates(review.parsed(b.withColumn("answer", answer)))


def q_release_hash_diff(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.md5("text").alias("sha256"), "doc_id")
    new = docs.filter("doc_id % 5 <> 0")
    old = docs.filter("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("sha256")))
    return review.release_diff(new, old)


# ---- evaluation


def q_benchmark_recall(s, d):
    r = evaluation.recall_summary(evaluation.recall_rows(pairs(s, d), entries(s, d)))
    return rounded(r, "recall", "adjusted_recall")


def pairs(s, d):
    """(latin_input, expected): words of benchmark texts with a spelling that may be known."""
    b = read(s, d, "benchmark").select(F.explode(tokenize(F.col("text"), LATIN)).alias("expected")).filter(T.is_valid(F.col("expected"), LATIN)).distinct()
    return b.select(F.when(F.length("expected") % 3 == 0, F.reverse("expected")).otherwise(F.regexp_replace("expected", "[aeiou]", "")).alias("latin_input"), "expected")


def q_benchmark_missed(s, d):
    return evaluation.missed(evaluation.recall_rows(pairs(s, d), entries(s, d)))


def q_ranking_coverage_rollup(s, d):
    b = read(s, d, "benchmark").select("item_id", tokenize(F.col("text"), LATIN).alias("t"))
    b = b.select(F.when(F.col("item_id") % 3 == 0, "baseline").when(F.col("item_id") % 3 == 1, "bigram").otherwise("compound").alias("type"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.get("t", F.lit(0))).alias("context"), F.get("t", F.lit(1)).alias("expected_top"))
    asked = b.select(F.explode(F.array("context", "expected_top")).alias("word"))
    g = cut(ngrams.raw_merged(ngrams.text_counts(corpus(s, d), LATIN, (1, 2), asked)), "asked")
    return evaluation.ranking_coverage(b, g.filter("n = 1").select(F.col("w1").alias("word")), g.filter("n = 2"))


def with_item(s, d):
    """Documents with item_id: each goes to the benchmark item of its number, modulo the number of items, which are numbered from 0."""
    items = read(s, d, "benchmark").count()
    return read(s, d, "documents").withColumn("item_id", F.pmod(F.col("doc_id"), F.lit(max(items, 1))))


def ranked_candidates(s, d):
    """(candidates, expected) of documents: the distinct words of a text in order of their first place, and the word of the benchmark item of its number."""
    b = read(s, d, "benchmark").select("item_id", F.get(F.split("text", " "), F.lit(2)).alias("expected"))
    return with_item(s, d).select("item_id", F.array_distinct(F.split("text", " ")).alias("candidates")).join(F.broadcast(b), "item_id")


def q_metrics_mrr_p_at_k(s, d):
    return rounded(evaluation.ranking_metrics(ranked_candidates(s, d)), "p_at_1", "p_at_3", "p_at_10", "mrr", "coverage")


def q_metrics_word_f1(s, d):
    b = read(s, d, "benchmark").select("item_id", F.split("text", " ").alias("e"))
    j = with_item(s, d).select("doc_id", "item_id", F.split("text", " ").alias("p")).join(F.broadcast(b), "item_id")
    return j.select("doc_id", *[F.round(c, 9).alias(n) for n, c in evaluation.word_f1(F.col("p"), F.col("e")).items()])


# ---- variants


COMPONENTS = [("onset", "k", ["k", "g"]), ("onset", "s", ["s"]), ("onset", "w", ["w", "v"]), ("onset", "d", ["d"]), ("onset", "kh", ["kh", "k"]), ("vowel", "a", ["a", "u", "ah"]), ("vowel", "aa", ["aa", "a", "ar", "ah"]), ("vowel", "i", ["i"]), ("vowel", "ii", ["i", "ee", "ii"]), ("coda", "n", ["n"]), ("coda", "w", ["w", "o", "u"]), ("coda", "s", ["s", "t"]), ("coda", "t", ["t", "d"])]
LEXICON = [("w1", "kin", "kin0", "กิน"), ("w2", "khao", "khaaw2", "ข้าว"), ("w3", "sawatdi", "sa1'wat1~dii0", "สวัส~ดี"), ("w4", "khiu", "khiw0", "คิว")]


def q_syllable_variants(s, d):
    table = s.createDataFrame(COMPONENTS, "kind string, g2p string, variants array<string>")
    own = lambda kind: [(g,) for k, g, _ in COMPONENTS if k == kind]
    rows = [(o, v, c) for (o,) in own("onset") for (v,) in own("vowel") for (c,) in [*own("coda"), ("",)]]
    syl = s.createDataFrame(rows, "onset string, vowel string, coda string").select(F.concat_ws("-", "onset", "vowel", "coda").alias("syllable_id"), "onset", "vowel", "coda")
    return variants.native_syllable_variants(variants.component_lists(syl, table)).select("syllable_id", joined("variants"))


def q_word_variants(s, d):
    known = variants.components(s.createDataFrame(COMPONENTS, "kind string, g2p string, variants array<string>"))
    lex = s.createDataFrame(LEXICON, "word string, base_roman string, g2p string, segments string")
    return variants.generated(lex, known).select("word", joined("romanizations"))


def q_g2p_parse(s, d):
    known = variants.components(s.createDataFrame(COMPONENTS, "kind string, g2p string, variants array<string>"))
    lex = s.createDataFrame(LEXICON, "word string, base_roman string, g2p string, segments string")
    return variants.parsed(lex, known).select("word", F.posexplode("syllables").alias("i", "x")).select("word", "i", "x.onset", "x.vowel", "x.coda", "x.tone")


# ---- lattices


def search_keys(s, d):
    """Keys of all words: the words themselves."""
    return merged(s, d).select(F.col("word").alias("romanization_key"), F.xxhash64("word").alias("word_id"), "word", F.round("freq", 12).alias("frequency"))


def run_together(s, d):
    """Whole benchmark texts, their words run together."""
    t = F.filter(tokenize(F.col("text"), LATIN), lambda x: T.is_valid(x, LATIN))
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(t, "").alias("input"))


def single_words(s, d):
    """Every distinct word of the benchmark texts, by a number of its own."""
    w = read(s, d, "benchmark").select(F.explode(tokenize(F.col("text"), LATIN)).alias("input")).filter(T.is_valid(F.col("input"), LATIN)).distinct()
    return w.select(F.conv(F.substring(F.md5("input"), 1, 15), 16, 10).cast("long").alias("query_id"), "input")


def q_lattice_edges(s, d):
    return lattice.edges(run_together(s, d), search_keys(s, d)).select("query_id", "s", "e", "word")


def q_kbest_paths_exhaustive(s, d):
    found = lattice.exhaustive(cut(lattice.edges(single_words(s, d), search_keys(s, d)), "lattice"), UNIGRAM_SEARCH)
    return rounded(found, "cost").select("query_id", "words", "cost")


def q_kbest_paths_viterbi(s, d):
    found = lattice.search(lattice.edges(single_words(s, d), search_keys(s, d)), SearchConfig(penalty=0.5, floor=1e-7, ngram_weight=0.0, k=10))
    return rounded(found.filter("rank = 1"), "cost").select("query_id", "output", "cost")


def q_beam_search_trigram(s, d):
    found = cut(lattice.edges(run_together(s, d), search_keys(s, d)), "lattice")
    uni, bi, tri = (cut(x, "scores") for x in scores(s, d, inside=found.select("word")))
    return rounded(lattice.search(found, SearchConfig(), uni, bi, tri), "cost")


# ---- files: what a writer writes in the shared folder, as its reader reads it


def q_source_lines(s, d):
    """Lines of conversations from a text file, one each."""
    path = new_path(s, "lines")
    read(s, d, "conversations").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return readers.texts(s, "lines", path)


def q_source_delimited(s, d):
    """Texts with line breaks and quotes from a file with `;`."""
    path = new_path(s, "delimited")
    read(s, d, "documents").select("text", F.lit("5").alias("rating")).write.csv(path, sep=";", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.texts(s, "delimited", path)


def q_source_titled(s, d):
    """Titles and bodies of JSON lines."""
    path = new_path(s, "titled")
    read(s, d, "documents").select(F.concat_ws(" ", F.lit("No."), "doc_id").alias("title"), F.col("text").alias("body_text")).write.json(path)
    return readers.texts(s, "titled", path)


def q_source_wiki(s, d):
    """Texts of a dump in XML, two revisions a page."""
    path = new_path(s, "wiki")
    marked = lambda before, after: F.struct(F.concat(F.lit(before), "text", F.lit(after)).alias("text"))
    revisions = F.array(marked("[[File:x.png]] [[x|", "]]"), marked("'" * 3, "'" * 3 + "<ref>r</ref>"))
    read(s, d, "benchmark").select(F.concat_ws(" ", F.lit("Page"), "item_id").alias("title"), revisions.alias("revision")).write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.texts(s, "wiki", path)


def q_source_words(s, d):
    """A dictionary's words, without comments and blank lines."""
    path = new_path(s, "words")
    w = merged(s, d).select(F.when(F.length("word") % 7 == 0, F.concat(F.lit("# "), "word")).otherwise(F.concat(F.lit(" "), "word", F.lit("  "))).alias("value"))
    w.unionByName(s.createDataFrame([("",), ("  ",), ("#",)], "value string")).write.text(path)
    return readers.words(s, path)


def q_file_gram_counts(s, d):
    """Counts of bigrams, written as tab-separated lines and read again."""
    path = new_path(s, "grams")
    sinks.gram_counts(cut(ngrams.text_raw(corpus(s, d), LATIN, CORPORA, (2,)), "grams"), 2, path)
    return readers.grams(s, path).select(F.get("gram", F.lit(0)).alias("w1"), F.get("gram", F.lit(1)).alias("w2"), F.col("value").cast("long").alias("cnt"))


def q_file_gram_freqs(s, d):
    path = new_path(s, "grams")
    sinks.gram_freqs(measured(s, d, (1,)), 1, path)
    return readers.grams(s, path).select(F.get("gram", F.lit(0)).alias("w1"), F.round("value", 12).alias("freq"))


def q_file_tokens(s, d):
    """Token files: the tokens of each corpus."""
    path = new_path(s, "tokens")
    sinks.text_tokens(corpus(s, d), LATIN, path)
    return s.read.text(path).filter("value <> ''").groupBy("corpus", F.col("value").alias("word")).agg(F.count("*").alias("cnt"))


def q_file_wordlist(s, d):
    path = new_path(s, "wordlist")
    sinks.wordlist(frequency.wordlist(merged(s, d).withColumn("freq", F.round("freq", 12))), path)
    return readers.wordlist(s, path).select(F.col("rank").cast("long"), "word", "frequency", F.col("source_count").cast("int"), F.array_join("sources", "|").alias("sources"))


def q_file_first_words(s, d):
    path = new_path(s, "wordlist")
    sinks.wordlist(frequency.wordlist(merged(s, d).withColumn("freq", F.round("freq", 12))), path)
    return readers.first_words(s, path, 100).select(F.col("rank").cast("long"), "word")


def q_file_variants(s, d):
    path = new_path(s, "variants")
    sinks.variants(spelled(merged(s, d)), path)
    return s.read.parquet(path).select("word", joined("romanizations"))


def q_file_flat_keys(s, d):
    path = new_path(s, "flat")
    sinks.flat(wordlist.flat_keys(identified(s, d)), path)
    return readers.table(s, path, "word_id long, word string, romanization_key string, frequency double, sources string")


def q_file_report(s, d):
    path = new_path(s, "report")
    sinks.report(pairs(s, d), path)
    # an empty field is read as null
    return readers.table(s, path, "latin_input string, expected string", comments=True).withColumn("latin_input", F.coalesce("latin_input", F.lit("")))


def q_corpus_sizes(s, d):
    """Texts, tokens and valid tokens of each corpus."""
    t = tokens(s, d)
    return t.groupBy("corpus").agg(F.count("*").alias("texts"), F.sum(F.size("tokens")).cast("long").alias("tokens"), F.sum(F.size(F.array_compact("tokens"))).cast("long").alias("valid_tokens"))


# ---- streams


def q_streaming_word_counts(s, d):
    from ..streaming.counts import word_counts

    schema = read(s, d, "documents").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*").select(F.col("lang").alias("corpus"), "text")
    path = new_path(s, "stream")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/updates/part={number}")

    q = word_counts(stream, LATIN).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    updates = s.read.schema("corpus string, word string, cnt long, batch int").parquet(f"{path}/updates")
    return updates.groupBy("corpus", "word").agg(F.max_by("cnt", "batch").alias("cnt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_")}
