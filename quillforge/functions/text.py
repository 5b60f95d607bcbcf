"""Text functions on Columns. Four normalisers, three error rates and two accuracies are different on purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: look-alike letters, glyphs that are hard to draw, and a transliteration
LATIN_LOOKALIKES = "ABCEHKMOPTXaceopx"
CYRILLIC_LOOKALIKES = "АВСЕНКМОРТХасеорх"
HARD_GLYPHS = "ЖЩЪЫЁЮЯЭЦЧШ"
RARE_LETTERS = "ёЁжЖцЦщЩъЪ"
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–…«»№"
_PUNCT_CLASS = "[" + "".join("\\" + c if not c.isalnum() else c for c in PUNCTUATION) + "]"


def chars(text: Column) -> Column:
    """Characters of a text, none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def fold(text: Column) -> Column:
    """Lower case with ß as ss, which is case folding for Latin and Cyrillic letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def homoglyphs(text: Column) -> Column:
    return F.translate(text, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)


def normal_match(text: Column, lookalikes: bool = False) -> Column:
    """Folded, trimmed, white space collapsed; look-alikes unified first if asked."""
    return collapse(fold(homoglyphs(text) if lookalikes else text))


def normal_words(text: Column) -> Column:
    """All but letters, numbers and white space becomes a space, then as ``normal_match``."""
    return normal_match(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s]", " "))


def normal_target(text: Column) -> Column:
    """Upper case, trimmed, white space collapsed (split hygiene)."""
    return collapse(F.upper(text))


def normal_space(text: Column) -> Column:
    """Trimmed and collapsed, case kept."""
    return collapse(text)


def target_digest(text: Column) -> Column:
    return F.sha2(normal_target(text), 256)


def _rate(hypothesis: Column, reference: Column) -> Column:
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(hypothesis, reference) / F.length(reference))


def error_rate(hypothesis: Column, reference: Column, lookalikes: bool = False) -> Column:
    """Edit distance of normalised texts over the reference's length; may exceed 1."""
    return _rate(normal_match(hypothesis, lookalikes), normal_match(reference, lookalikes))


def pieces_error_rate(pieces: Column, words: Column) -> Column:
    """Recognised pieces against words, both joined without spaces, look-alikes unified, lower case; at most 1."""
    a, b = (F.lower(homoglyphs(F.array_join(x, ""))) for x in (pieces, words))
    return F.least(F.lit(1.0), F.levenshtein(a, b) / F.greatest(F.length(b), F.lit(1)))


def plain_error_rate(hypothesis: Column, reference: Column) -> Column:
    """As ``error_rate`` without look-alikes; a reference of white space only counts as empty."""
    return _rate(normal_match(hypothesis), normal_match(reference))


def character_metrics(detected: Column, target: Column) -> dict[str, Column]:
    """Characters that agree position by position, over the longer text, and what was detected."""
    a, b = normal_match(F.coalesce(detected, F.lit(""))), normal_match(F.coalesce(target, F.lit("")))
    matches = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x == y), lambda same: same))
    total = F.greatest(F.length(a), F.length(b))
    exact = (a == b) & (b != "")
    return {
        "char_matches": matches,
        "char_total": total,
        "char_accuracy": F.when(total == 0, 1.0).otherwise(matches / total),
        "exact_text_match": exact,
        "detection_status": F.when(a == "", "not_detected").when(exact, "detected_exact").otherwise("detected_mismatch"),
    }


def bag_accuracy(predicted: Column, target: Column) -> Column:
    """Characters in common whatever their order, less half of the relative excess length; not below 0."""
    a, b = F.trim(F.lower(predicted)), F.trim(F.lower(target))

    def times(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    common = F.aggregate(F.array_distinct(chars(b)), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    excess = F.greatest(F.lit(0), F.length(a) - F.length(b)) / F.length(b)
    empty = F.when(F.length(a) == 0, 1.0).otherwise(0.0)
    return F.when(F.length(b) == 0, empty).otherwise(F.greatest(F.lit(0.0), common / F.length(b) - 0.5 * excess))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}"))


def script_mix(text: Column) -> dict[str, Column]:
    latin, cyrillic, every = (F.regexp_count(text, F.lit(p)) for p in ("[A-Za-z]", "[А-яЁё]", "\\p{L}"))
    return {
        "latin_letters": latin,
        "cyrillic_letters": cyrillic,
        "letter_count": every,
        "latin_letter_rate": F.when(every == 0, 0.0).otherwise(latin / every),
        "script_mixing_flag": (latin > 0) & (cyrillic > 0),
    }


def hard_glyphs(text: Column, glyphs: str = HARD_GLYPHS) -> Column:
    """Sorted distinct hard glyphs of the upper-cased text."""
    return F.array_sort(F.array_distinct(F.filter(chars(F.upper(text)), lambda c: F.instr(F.lit(glyphs), c) > 0)))


def _strip_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, _PUNCT_CLASS, "")


def mixed_case(text: Column) -> Column:
    """Some lower-case letter beside an all-capital word or a capital inside a word."""
    words = F.transform(F.split(F.regexp_replace(text, "[\\n ]+", " "), " "), _strip_punctuation)
    capital = F.exists(words, lambda w: (F.length(w) > 1) & w.rlike("\\p{Lu}") & ~w.rlike("\\p{Ll}"))
    inner = F.exists(words, lambda w: w.rlike("^.+\\p{Lu}"))
    return text.rlike("\\p{Ll}") & (capital | inner)


def present(*fields: Column) -> Column:
    """Whether some field holds more than blanks; zero and false count."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(f.cast("string")) != "", F.lit(False)) for f in fields])


def slice_labels(text: Column, style: list[Column] | None = None, scene: list[Column] | None = None, rare: str = RARE_LETTERS) -> Column:
    """Labels of difficulty, several per text, in a fixed order; none for a blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(F.regexp_replace(bare, "\\n", " "), " "), lambda w: w != "")
    tests = [
        (bare.rlike(f"[{rare}]"), "rare_cyrillic"),
        (bare.rlike("[\\p{Nd}²³¹]"), "has_digits"),
        (bare.rlike(_PUNCT_CLASS), "has_punctuation"),
        (text.rlike("[\\n\\r]"), "multiline"),
        (mixed_case(bare), "mixed_case"),
        (F.size(words) >= 2, "multi_word_phrase"),
        (F.size(words) == 1, "short_word"),
        (F.exists(words, lambda w: F.length(_strip_punctuation(w)) >= 10), "long_word"),
        (present(*style) if style else F.lit(False), "font_or_style"),
        (present(*scene) if scene else F.lit(False), "scene_or_background"),
    ]
    labels = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in tests]))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(labels)


def apply_case(text: Column, case: Column) -> Column:
    """upper, lower, title (each run of letters) or anything else to keep."""
    runs = F.regexp_extract_all(text, F.lit("(\\p{L}+|[^\\p{L}]+)"), 1)
    title = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return F.when(case == "upper", F.upper(text)).when(case == "lower", F.lower(text)).when(case == "title", title).otherwise(text)


def alternating_case(text: Column) -> Column:
    return F.array_join(F.transform(chars(text), lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c))), "")


def _latin_of() -> Column:
    return F.create_map(*[F.lit(x) for pair in TRANSLITERATION.items() for x in pair])


def transliterate(text: Column) -> Column:
    """Cyrillic to Latin letters, case kept; signs without a sound go."""
    table = _latin_of()

    def one(c: Column) -> Column:
        latin = F.element_at(table, F.lower(c))
        return F.when(latin.isNull(), c).when(c != F.lower(c), F.upper(latin)).otherwise(latin)

    return F.array_join(F.transform(chars(text), one), "")


def half_transliterate(text: Column) -> Column:
    """Every other letter that has a Latin form, from the first on; texts with fewer than two stay."""
    table, cs = _latin_of(), chars(text)
    can = F.transform(cs, lambda c: F.coalesce(F.element_at(table, F.lower(c)) != "", F.lit(False)))

    def one(c: Column, i: Column) -> Column:
        turn = F.element_at(can, i + 1) & (F.size(F.filter(F.slice(can, F.lit(1), i), lambda x: x)) % 2 == 0)
        latin = F.element_at(table, F.lower(c))
        return F.when(~turn, c).when(c != F.lower(c), F.upper(latin)).otherwise(latin)

    return F.when(F.size(F.filter(can, lambda x: x)) < 2, text).otherwise(F.array_join(F.transform(cs, one), ""))


def stage_text(text: Column, family: Column, number: Column, mark: Column) -> Column:
    """Text policy of a curriculum stage."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    half = F.floor(F.size(words) / 2).cast("int")
    two_lines = F.concat_ws(
        "\n", F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " ")
    )
    return (
        F.when(family == "digits", F.concat_ws(" ", text, number))
        .when(family == "punctuation", F.concat(text, mark))
        .when(family == "mixed_case", alternating_case(text))
        .when((family == "multiline") & (F.instr(text, "\n") == 0) & (F.size(words) >= 2), two_lines)
        .otherwise(text)
    )


def truncate_words(text: Column, limit: int = 30) -> Column:
    """Whole words from the start while the text stays within the limit; the first word is cut if it is too long."""
    words = F.split(text, " ")
    kept = F.aggregate(
        words,
        F.struct(F.lit("").alias("t"), F.lit(True).alias("go")),
        lambda a, w: F.struct(
            F.when(a["go"] & (F.length(F.concat_ws(" ", F.nullif(a["t"], F.lit("")), w)) <= limit), F.concat_ws(" ", F.nullif(a["t"], F.lit("")), w))
            .otherwise(a["t"])
            .alias("t"),
            (a["go"] & (F.length(F.concat_ws(" ", F.nullif(a["t"], F.lit("")), w)) <= limit)).alias("go"),
        ),
    )["t"]
    return F.when(F.length(text) <= limit, text).when(kept == "", F.substring(text, 1, limit)).otherwise(kept)


def fill_template(template: Column, **fields: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), fields.items(), template)


def clean_phrase(text: Column) -> Column:
    """Drops thinking tags, list numbers and surrounding quotes."""
    text = F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(text, "^\\s*(?:\\d+[.)]|[-*•])\\s*", "")
    return F.trim(F.regexp_replace(text, "^[\"'«»“”„\\s]+|[\"'«»“”„\\s]+$", ""))


SECRET_NAMES = "token|secret|password|passwd|api[_-]?key|authorization|credential"


def redact(text: Column) -> Column:
    """Bearer tokens and values of fields with a secret's name."""
    text = F.regexp_replace(text, "(?i)(bearer\\s+)\\S+", "$1<redacted>")
    return F.regexp_replace(text, f"(?i)\\b((?:[a-z0-9_]*)(?:{SECRET_NAMES})[a-z0-9_]*\\s*[=:]\\s*)[^\\s,;&]+", "$1<redacted>")


def redact_map(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(SECRET_NAMES), F.lit("<redacted>")).otherwise(redact(v)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def padded_id(number: Column, width: int = 6) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def version_of(path: Column, strict: bool = True) -> Column:
    """Version number of a file name ``v<n>.png``; the strict form allows no leading zeros."""
    found = F.regexp_extract(path, "(?:^|/)v(0|[1-9][0-9]*)\\.png$" if strict else "(?:^|/)v([0-9]+)\\.[a-z]+$", 1)
    return F.nullif(found, F.lit("")).cast("int")


def count_map(text: Column) -> Column:
    """How often each character occurs."""
    cs = chars(text)
    return F.map_from_entries(
        F.transform(F.array_sort(F.array_distinct(cs)), lambda c: F.struct(c, F.length(text) - F.length(F.replace(text, c, F.lit("")))))
    )
