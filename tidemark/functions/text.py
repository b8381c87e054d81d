"""Text columns. Character classes are spelled out, so that accented text reads alike in every engine."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words of English by class: articles, conjunctions, prepositions, pronouns, auxiliaries. A parameter everywhere.
STOP_WORDS = (
    "a", "an", "the",
    "and", "but", "or", "nor", "so", "yet", "because", "although", "while", "if", "unless", "than", "that",
    "of", "in", "on", "at", "by", "to", "from", "for", "with", "about", "into", "over", "under", "after", "before", "between", "through", "during", "without",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "these", "those", "who", "which", "what",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "not",
)


def surrogate_key(source: Column, key: Column) -> Column:
    """md5 of ``source:key``."""
    return F.md5(F.concat_ws(":", source, key))


def clean_markup(text: Column) -> Column:
    """Tags become blanks, white space collapses, and characters beyond words and common marks go."""
    text = F.regexp_replace(text, "<[^>]*>", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s.,!?:;()#@/-]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _runs(text: Column, letters: str, least: int, stop: tuple[str, ...]) -> Column:
    """Whole runs of ``letters`` of ``least`` characters or more that aren't stop words: one pass of a pattern that never steps back, and a look-up of each run."""
    runs = F.regexp_extract_all(text, F.lit(f"[{letters}]{{{least},}}+"), F.lit(0))
    long = [w for w in stop if len(w) >= least]
    return F.filter(runs, lambda w: ~w.isin(*long)) if long else runs


def words(text: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of ASCII letters and digits, without links, of ``least`` characters or more, without stop words."""
    return _runs(F.regexp_replace(F.lower(text), r"https?://[^\s]+", " "), "a-z0-9", max(1, least), stop)


def letters_only(text: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words for topic models: links, mentions, tags, marks and digits are gone."""
    return _runs(F.regexp_replace(F.lower(text), r"https?://[^\s]+|[@#][a-z0-9_]+", " "), "a-z", least, stop)


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark that white space follows."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def read_minutes(text: Column, per_minute: int = 200) -> Column:
    """Minutes to read, at least 1; 0 for empty text."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / per_minute))).cast("long")


def syllables(word: Column) -> Column:
    """Vowel groups without a final e, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(word, "e$", ""), F.lit("[aeiouy]+")))


def _reading_counts(text: Column) -> tuple[Column, Column, Column]:
    """Words, sentences and syllables. Syllables are counted on the whole text: vowel groups once final e's are gone, and one for each word that has none then."""
    low = F.lower(text)
    n_words, n_sentences = F.regexp_count(low, F.lit("[a-z]+")), F.size(sentences(text))
    groups = F.regexp_count(F.regexp_replace(low, "e(?![a-z])", ""), F.lit("[aeiouy]+"))
    n_syllables = groups + F.regexp_count(low, F.lit("(?<![a-z])(?:[b-df-hj-np-tv-xz]+e?|e)(?![a-z])"))
    return n_words, n_sentences, n_syllables


def flesch(text: Column) -> Column:
    """Flesch reading ease, at least 0; 50 where there is no word or sentence."""
    n_words, n_sentences, n_syllables = _reading_counts(text)
    ease = 206.835 - 1.015 * n_words / n_sentences - 84.6 * n_syllables / n_words
    return F.when((n_words == 0) | (n_sentences == 0), 50.0).otherwise(F.greatest(F.lit(0.0), ease))


def flesch_tenths(text: Column) -> Column:
    """``flesch`` to one decimal as SQL works it out: its factors are decimals, so products with counts are exact, and what is rounded is ten times the ease."""
    n_words, n_sentences, n_syllables = _reading_counts(text)
    ease = 206.835 - n_words.cast("long") * 1015 / 1000 / n_sentences - n_syllables.cast("long") * 846 / 10 / n_words
    return F.when((n_words == 0) | (n_sentences == 0), 50.0).otherwise(F.round(F.greatest(F.lit(0.0), ease) * 10) / 10)


def meta_description(text: Column, most: int = 160) -> Column:
    """Whole sentences from the start, up to ``most`` characters; of a first sentence that is longer, its whole words."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    whole = F.regexp_extract(F.substring(clean, 1, most + 1), r"(?s)^(.*[.!?]) ", 1)
    return F.when(F.length(clean) <= most, clean).when(whole != "", whole).otherwise(F.regexp_replace(F.substring(clean, 1, most), " [^ ]*$", ""))


def mentions(text: Column) -> Column:
    """Distinct ``@names`` of 2 to 30 characters after a blank or the start."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|\s)@([A-Za-z0-9_]{2,30})"), F.lit(1)))


def hashtags(text: Column) -> Column:
    """Distinct ``#tags`` of 2 to 50 characters in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_]{2,50})"), F.lit(1)), F.lower))


def links(text: Column) -> Column:
    """Distinct links without closing marks."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,;:!?)]+$", "")))


def normal_url(url: Column) -> Column:
    """Lower case, without scheme, www, fragment, tracking parameters and a closing slash."""
    url = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    url = F.regexp_replace(url, "#.*$", "")
    url = F.regexp_replace(url, r"([?&])((utm_[a-z]+|ref|source)=[^&]*(&|$))+", "$1")
    return F.regexp_replace(F.regexp_replace(url, "[?&]+$", ""), "/+$", "")


def mask_email(text: Column) -> Column:
    """``a***@domain`` for every address."""
    return F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+)", "$1***@$2")


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs in lower-case ``text``, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")
