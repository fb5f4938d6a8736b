"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Script:
    """What a word of a script looks like. Classes are bodies of regular-expression classes in Java's syntax."""

    name: str
    letters: str
    consonants: str  # a word needs one of these, unless empty
    repeater: str = ""  # a mark that may neither lead a word nor be all of it
    base: str = ""  # letters that count for a word's base length; all, if empty
    nuclei: str = "aeiouy"
    nucleus_pairs: tuple[str, ...] = ()  # patterns of two or three letters that are one nucleus
    silencer: str = ""  # marks a silent consonant
    shortest: int = 2
    longest: int = 30
    tokens: str = ""  # a pattern all of whose matches are the tokens of lower-case text


#: Ranges of Unicode.
LATIN = Script("latin", "a-zß-öø-ÿœ", "", tokens=r"[a-zß-öø-ÿœ]+|[^a-zß-öø-ÿœ\s]+", base="a-zß-öø-ÿœ", nuclei="aeiouyäöüéèêáíóú")
THAI = Script(
    "thai", "ก-ฺเ-๎", "ก-ฮ", repeater="ๆ", base="ก-ูเ-ไ็",
    nuclei="ะ-ูเ-ๅ็", nucleus_pairs=("เ.็", "เ.า", "เ.ีย"), silencer="์",
    tokens=r"[ก-ฺเ-๎]+|[^ก-ฺเ-๎\s]+",
)


@dataclass(frozen=True)
class WordlistConfig:
    min_source_count: int = 2
    min_frequency: float = 5e-6
    vocab_limit: int = 0  # 0: none
    max_length_ratio: float = 2.0
    max_variants: int = 100
    compound_min_chars: int = 10
    part_min_chars: int = 3
    exempt_source: str = "dictionary"  # words that only this source has need no second source


@dataclass(frozen=True)
class ModelConfig:
    count_min: int = 2  # of the count tables
    min_count: int = 15  # of n-grams in the model
    min_source_count: int = 2
    min_frequency: float = 5e-6
    alpha: float = 0.4
    floor: float = 6e-6
    smoothing: str = "sbo"

    def __post_init__(self) -> None:
        if self.smoothing != "sbo":
            raise ValueError(f"only sbo is implemented, not {self.smoothing}")


@dataclass(frozen=True)
class SearchConfig:
    """Costs of the candidate search: -ln(max(frequency, floor)) + penalty for each word, and n-gram scores."""

    penalty: float = 1.0
    floor: float = 5e-6
    ngram_weight: float = 2.0
    beam_multiplier: int = 4
    k: int = 10


UNIGRAM_SEARCH = SearchConfig(penalty=0.5, floor=1e-7, ngram_weight=0.0)


@dataclass(frozen=True)
class BenchmarkConfig:
    corpora: tuple[str, ...] = ()
    top_k: int = 500
    max_variants: int = 100


@dataclass(frozen=True)
class ReviewConfig:
    batch: int = 1000
    limit: int = 5000


@dataclass(frozen=True)
class Config:
    script: Script = LATIN
    wordlist: WordlistConfig = field(default_factory=WordlistConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    benchmark: BenchmarkConfig = field(default_factory=BenchmarkConfig)
    review: ReviewConfig = field(default_factory=ReviewConfig)
