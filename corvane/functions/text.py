"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
# No character begins both kinds of token, so the common kind stands first, its commonest characters as a plain range.
TOKEN = r"[a-z\p{L}\p{Nl}\p{No}]+|\p{Nd}+(?:\.\p{Nd}+)*"
COUNTED = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1C}-\x{1F}\x{85}]"
ELISIONS = "l d j m t s n c qu jusqu lorsqu puisqu quoiqu".split()
FRENCH = """
    a au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais
    me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta
    te tes toi ton tu un une vos votre vous y etre avoir fait faire plus tout tous toute
    toutes autre autres comme si sans sous entre chaque tel telle telles tels ainsi alors
    donc car ni or cette cet celui celle ceux celles dont lorsque afin selon
    est sont ont eu ete etait seront peut peuvent doit doivent quel quelle quels quelles
    quoi comment pourquoi quand ou lequel laquelle lesquels lesquelles vers apres avant
    pendant depuis chez leurs notamment ainsi lors doit-il est-ce
""".split()
ENGLISH = """
    a an and are as at be been being but by for from had has have he her his i if in into is
    it its of on or she that the their them there these they this to was were what when
    where which who will with would you your shall may such other than then those any each
    all also both more most no not only same so some very do does did how why whose
    about after before during under between within must can could should would
""".split()
MARKERS = """
    paragraphe paragraphes annexe considerant considerants reglement systeme systemes
    donnees traitement deployeur fournisseur interdites entreprise
""".split()
ACCENTS = "àâçèéêëîïôùû"
PII = (
    ("[EMAIL]", r"[\w.+-]+@[\w-]+\.[\w.-]*[\w]"),
    ("[IBAN]", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("[CARD]", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
    ("[NIR]", r"\b[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}\b"),
    ("[PHONE]", r"\b(?:\+33|0)[ .-]?[1-9](?:[ .-]?\d{2}){4}\b"),
    ("[PHONE]", r"\+\d{1,3}[ .-]?(?:\d[ .-]?){7,12}\d"),
)
HEADING = r"^(?:(\d+(?:\.\d+)*)\.|(\d+(?:\.\d+)+))\s+(\S.{0,110})$"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
LEADER = r"\.{4,}"
LEADING_NUMBER = r"^\d+\.\s+"

STOPWORDS = {"en": sorted(set(ENGLISH)), "fr": sorted(set(FRENCH) | set(ELISIONS))}
_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def words_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def straight(text: Column) -> Column:
    """Typographic apostrophes as the ASCII one."""
    return F.translate(text, "’", "'")


def tokens(text: Column) -> Column:
    """Dotted numbers and runs of letters, lower-cased. Apostrophes of either form stand between tokens, so none is made straight."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column, language: Column) -> Column:
    """Tokens without the language's stop words; numbers always stay. Null text has none."""
    every = tokens(text)
    english, french = F.filter(every, lambda t: ~t.isin(STOPWORDS["en"])), F.filter(every, lambda t: ~t.isin(STOPWORDS["fr"]))
    return F.coalesce(F.when(language == "fr", french).otherwise(english), F.array().cast("array<string>"))


def analyse(text: Column, language: Column) -> Column:
    """Content tokens, stemmed for their language."""
    from .stem import stem_tokens

    return stem_tokens(content_tokens(text, language), language)


def strip_accents(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def folded(text: Column) -> Column:
    """Lower case for comparisons: also of letters whose lower case is no single letter or has two forms."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def detect_language(text: Column) -> Column:
    """``fr`` by accents, then by marker words, then by more distinct stop words; else ``en``."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(straight(text), F.lit(TOKEN), F.lit(0)), lambda w: strip_accents(F.lower(w))))
    hits = lambda lexicon: F.size(F.array_intersect(words, words_array(lexicon)))
    french = F.lower(text).rlike(f"[{ACCENTS}]") | (hits(MARKERS) > 0) | (hits(STOPWORDS["fr"]) > hits(STOPWORDS["en"]))
    return F.when(F.coalesce(french, F.lit(False)), "fr").otherwise("en")


def normalise_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s ]+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s ]+|[\s ]+$", "")


def token_count(text: Column) -> Column:
    """Words and single symbols."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COUNTED), F.lit(0)))


def redact(text: Column) -> Column:
    for name, pattern in PII:
        text = F.regexp_replace(text, "(?U)" + pattern, name.replace("[", r"\[").replace("]", r"\]"))
    return text


def has_pii(text: Column) -> Column:
    """Whether any pattern matches."""
    found = F.lit(False)
    for _, pattern in PII:
        found = found | text.rlike("(?U)" + pattern)
    return F.coalesce(found, F.lit(False))


def redact_map(attributes: Column) -> Column:
    """Only the entries that redaction changes."""
    return F.map_filter(F.transform_values(attributes, lambda _, v: F.when(redact(v) != v, redact(v))), lambda _, v: v.isNotNull())


def provision_text(paragraphs: Column) -> Column:
    lines = F.transform(paragraphs, lambda p: F.when(F.coalesce(p["label"], F.lit("")) == "", p["text"]).otherwise(F.concat(p["label"], F.lit(" "), p["text"])))
    return strip(F.array_join(lines, "\n"))


def citation(kind: Column, number: Column, title: Column) -> Column:
    return (
        F.when(kind == "art", F.concat(F.lit("Article "), number))
        .when(kind == "rct", F.concat(F.lit("Recital ("), number, F.lit(")")))
        .when(kind == "anx", F.concat(F.lit("Annex "), number))
        .otherwise(F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Section "), number)))
    )


def embedding_text(header: Column, text: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n"), text)).otherwise(text)


def provision_id(source: Column, kind: Column, number: Column) -> Column:
    """Null without a source."""
    return F.when(source.isNotNull(), F.concat_ws(":", source, kind, number))


def snippet(text: Column, length: int = 140) -> Column:
    return F.concat(normalise_space(F.substring(text, 1, length)), F.lit("..."))


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_json(arguments: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(arguments))))
