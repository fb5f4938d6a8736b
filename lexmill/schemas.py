"""Declared schemas of all tables; nothing is inferred."""

from __future__ import annotations

TEXTS = "corpus string, doc_id long, text string"
TOKENS = "corpus string, doc_id long, tokens array<string>"
COUNTS = "corpus string, n int, gram array<string>, cnt long"
FREQUENCIES = "word string, frequency double"
WORDLIST = "rank int, word string, frequency double, source_count int, sources string"
ENTRIES = "word_id long, word string, frequency double, sources array<string>, romanizations array<string>"
FLAT = "word_id long, word string, romanization_key string, frequency double, sources string"
VARIANTS = "word string, romanizations array<string>"
COMPONENTS = "kind string, g2p string, variants array<string>"
LEXICON = "word string, base_roman string, g2p string, segments string"
BENCHMARK = "latin_input string, expected string, category string, difficulty string, notes string"
SEGMENTATION = "latin_input string, expected_segmentation string, category string, notes string"
RANKING = "latin_input string, context string, expected_top string, valid_alternatives string, type string, notes string"
DECISIONS = "word string, review_status string, category string, difficulty string, variants array<string>"
UNIGRAMS = "word_id int, score float"
BIGRAMS = "w1 int, w2 int, score float"
TRIGRAMS = "w1 int, w2 int, w3 int, score float"
SYLLABLE = "struct<onset:string,vowel:string,coda:string,tone:string,segment:string>"


def _entry_struct() -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in ENTRIES.split(", ")))


DATASET = f"metadata struct<version:string,generated_at:string,vocab_size:bigint,total_romanization_keys:bigint,unique_romanization_keys:bigint,sources:array<string>>, entries array<struct<{_entry_struct().replace('long', 'bigint')}>>"
