"""Text functions, columns in and columns out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sieveline.schemas import MIN_KEY_CHARS

# Letters that look alike in two scripts.
LATIN = "aceopxykbmtn"
CYRILLIC = "асеорхуквмтн"

# Title patterns of the sampling buckets, in order.
BUCKETS = {
    "slr": "зенит|canon ae|nikon f[ma]|pentax k|minolta|olympus om",
    "tlr": "любитель|rolleiflex|yashica mat",
    "rangefinder": "фэд|зоркий|leica|kiev|киев|смена",
    "instant": "polaroid|instax|fujifilm mini",
    "compact": "mju|prima|skina|zoom",
}

# What rules a title out of dictionary matching.
NEGATIVE = (
    r"^\s*(?:картридж|плёнк|пленк|фотобумаг|проявител|фиксаж|объектив|вспышк|чехол|ремешок|крышк|штатив|коробк|инструкц|паспорт|гаранти|"
    r"запчаст|детал|адаптер|лот|комплект|набор|коллекци)"
    r"|\bцифров|\bdigital|\bdslr|\bфотоаппарат(?:ы|ов|ам|ами|ах)\b|\bв футляре\b|\bв чехле\b"
)

# Lexical flags.
FLAGS = {
    "lot": r"ассортимент|комплект|\bлот\b|набор|несколько|\+",
    "parts": r"запчаст|в ремонт|неисправ|не работает|разбит",
    "accessory": r"видоискатель|чехол|коробк|футляр|вспышк|ремень",
    "movie": r"\bкино",
    "digital": r"цифров",
}

# Subtypes of what isn't labelled, in order.
SUBTYPES = {
    "other_parts": r"запчаст|в ремонт|неисправ|не работает|\bразбит|нерабоч|на детали",
    "other_lot": r"ассортимент|\bлот\b|комплект из|несколько фотоаппарат|[2-9]\s*фотоаппарат",
    "other_movie": r"кинокамер|киносъ|\bкино",
    "other_accessory": r"видоискатель|вспышк|чехол|футляр|\bсумк|объектив|переходник|адаптер",
    "other_digital": r"цифров|беззеркальн|mirrorless|nikon\s*z|\bom-5|зеркальн",
    "other_box": r"коробк|упаковк",
}

# Titles that name no model.
GENERIC_TITLES = ["фотоаппарат", "пленочный фотоаппарат", "камера", "фотик"]


def script_counts(x: Column) -> tuple[Column, Column]:
    """Cyrillic and Latin letters of a lower-case text."""
    return F.char_length(F.regexp_replace(x, "[^а-я]", "")), F.char_length(F.regexp_replace(x, "[^a-z]", ""))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def normalise_name(name: Column) -> Column:
    """A name in the form in which dictionary keys are written.

    Lower case; ё and э as е; look-alike letters of a token go to the script that most of its letters have, those
    of a one-letter token to the script of the rest of the text; letters and digits are parted; Roman one to three
    become digits. Not idempotent: a second pass may vote otherwise.
    """
    flat = F.regexp_replace(F.regexp_replace(F.lower(name), "[ёэ]", "е"), "[^a-zа-я0-9]+", " ")

    def voted(text: Column) -> Column:
        return bound(F.struct(*script_counts(text)), lambda whole: F.array_join(F.transform(F.array_remove(F.split(text, " "), ""), lambda t: vote(t, whole["col1"], whole["col2"])), " "))

    def vote(token: Column, all_cyr: Column, all_lat: Column) -> Column:
        cyr, lat = script_counts(token)
        # a token of two letters or more votes for itself, a single letter asks the others
        more_cyr = F.when(cyr + lat >= 2, cyr > lat).when(cyr + lat == 1, all_cyr - cyr > all_lat - lat)
        more_lat = F.when(cyr + lat >= 2, lat > cyr).when(cyr + lat == 1, all_lat - lat > all_cyr - cyr)
        return F.when(more_cyr, F.translate(token, LATIN, CYRILLIC)).when(more_lat, F.translate(token, CYRILLIC, LATIN)).otherwise(token)

    # in a text of one script every vote leaves it as it is
    joined = bound(flat, lambda x: F.when(x.rlike("[а-я]") & x.rlike("[a-z]"), voted(x)).otherwise(x))
    parted = F.regexp_replace(F.regexp_replace(joined, "([a-zа-я])([0-9])", "$1 $2"), "([0-9])([a-zа-я])", "$1 $2")
    # with two spaces between tokens each has its own on either side
    padded = F.concat(F.lit(" "), F.replace(parted, F.lit(" "), F.lit("  ")), F.lit(" "))
    for roman, digit in (("iii", "3"), ("ii", "2"), ("i", "1")):
        padded = F.replace(padded, F.lit(f" {roman} "), F.lit(f" {digit} "))
    return F.trim(F.regexp_replace(padded, " +", " "))


def duplicate_form(text: Column) -> Column:
    """Lower-case letters and digits of two scripts, one space between tokens; null becomes empty."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[а-яёa-z0-9]+"), F.lit(0)), " ")


def text_key(title: Column, description: Column, min_chars: int = MIN_KEY_CHARS) -> Column:
    """Key under which texts count as equal; null if the description is too short to tell."""
    return bound(duplicate_form(description), lambda d: F.when(F.char_length(d) >= min_chars, F.concat(duplicate_form(title), F.lit("\u0000"), d)))


def joined_text(title: Column, description: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def first_match(text: Column, patterns: Mapping[str, str], otherwise: str) -> Column:
    """Name of the first pattern, in order, that the lower-case text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike("(?U)" + p), F.lit(k)) for k, p in patterns.items()], F.lit(otherwise))


def title_bucket(title: Column) -> Column:
    return first_match(title, BUCKETS, "unknown")


def silver_subtype(text: Column) -> Column:
    return first_match(text, SUBTYPES, "other_rest")


def is_ruled_out(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?iuU)" + NEGATIVE)


def flags(text: Column, patterns: Mapping[str, str] = FLAGS) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return {k: low.rlike("(?U)" + p).cast("byte") for k, p in patterns.items()}


def names_pattern(names: Sequence[str]) -> str:
    """Pattern of normalised names at word boundaries; of names that begin at one place the longest matches.

    Names share their beginnings in it, so a place where none begins costs a look at one letter.
    """
    tree: dict = {}
    for n in names:
        node = tree
        for c in n:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [c + written(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        body = "(?:" + "|".join(ways) + ")"
        return body + "?" if "" in node else body

    return r"(?U)\b" + written(tree) + r"\b"


def html_title(html: Column) -> Column:
    """Text of the first h1, without tags; else the first image's alt text; else empty."""
    h1 = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    alt = F.regexp_extract(html, r'<img[^>]+alt="([^"]+)"', 1)
    return F.when(html.rlike(r"(?s)<h1[^>]*>.*?</h1>"), F.btrim(F.regexp_replace(h1, "<[^>]+>", ""), F.lit(" \t\n\r"))).otherwise(F.btrim(alt, F.lit(" \t\n\r")))


def html_image(html: Column, host: str = r"\d+\.img\.[a-z.]+") -> Column:
    """Address of the first image on the picture host, or null."""
    found = F.regexp_extract(html, rf'<img[^>]+src="(https?://{host}/image/[^"]+)"', 1)
    return F.when(found != "", found)


def swap_host(url: Column, old: str, new: str) -> Column:
    """The first occurrence of a host replaced."""
    at = F.instr(url, old)
    return F.when(at > 0, F.concat(F.substring(url, F.lit(1), at - 1), F.lit(new), F.substring(url, at + len(old), F.char_length(url)))).otherwise(url)


def split_prompt(prompt: Column, marker: str) -> Column:
    """(prefix, suffix) around a marker that must stand exactly once; null otherwise."""
    parts = F.split(prompt, "\\Q" + marker + "\\E")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("prefix"), parts[1].alias("suffix")))


def fill_prompt(template: Column, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by the value, by nothing where it's null."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def size_bucket(count: Column) -> Column:
    return F.when(count >= 50, F.lit("large")).when(count >= 5, F.lit("medium")).otherwise(F.lit("small"))


def popularity_bucket(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n <= 0, F.lit("no_kb")).when(n <= 20, F.lit("rare_kb")).otherwise(F.lit("popular_kb"))


def is_generic_title(title: Column) -> Column:
    return F.btrim(F.translate(F.lower(F.coalesce(title, F.lit(""))), "ё", "е"), F.lit(" \t\n\r")).isin(GENERIC_TITLES)


def image_path(image_id: Column, shards: int = 1000) -> Column:
    return F.concat(F.pmod(image_id, F.lit(shards)).cast("string"), F.lit("/"), image_id.cast("string"), F.lit(".jpg"))


def register(spark: SparkSession) -> None:
    """Makes slug, duplicate_form and text_key callable from SQL, and the Wilson bounds with them."""
    from sieveline.functions.stats import register as more

    form = "array_join(regexp_extract_all(lower(coalesce({0}, '')), '[а-яёa-z0-9]+', 0), ' ')"
    made = {
        "slug(x STRING)": "btrim(regexp_replace(lower(x), '[^a-z0-9]+', '_'), '_')",
        "duplicate_form(x STRING)": form.format("x"),
        "text_key(title STRING, description STRING)": f"CASE WHEN char_length({form.format('description')}) >= {MIN_KEY_CHARS} THEN concat({form.format('title')}, char(0), {form.format('description')}) END",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    more(spark)
