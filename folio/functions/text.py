"""Column functions over titles, lines and identifiers.  Patterns use (?U) so that blanks and digits of any script count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"

#: Standard titles of lists and back matter, in normal form.
BACK_MATTER = (
    "contributors", "notes on contributors", "about the authors", "about the contributors",
    "index", "indexes", "name index", "subject index",
    "register", "sachregister", "personenregister", "namensregister",
    "bibliography", "bibliographie", "literatur", "literaturverzeichnis", "references",
    "quellenverzeichnis", "acknowledgments", "acknowledgements", "danksagung", "remerciements",
    "glossary", "glossar", "glossaire", "abbreviations", "abkurzungsverzeichnis", "abkurzungen",
    "list of figures", "list of tables", "tabellenverzeichnis", "abbildungsverzeichnis",
    "les auteurs", "auteurs", "autorinnen und autoren", "die autorinnen und autoren",
    "verzeichnis der autorinnen und autoren", "zu den autorinnen und autoren",
    "liste des auteurs", "memento", "autorinnenverzeichnis", "autorenverzeichnis",
    "contents", "table of contents", "inhalt", "inhaltsverzeichnis", "inhaltsubersicht",
    "sommaire", "table des matieres",
)
#: Outline labels of pages that no printed contents list.
PRODUCTION = (
    "cover", "front cover", "back cover", "backcover",
    "half title", "half title page", "title", "title page",
    "copyright", "copyright page", "imprint", "impressum",
    "mentions legales", "sigles et acronymes",
    "liste des illustrations", "liste des tableaux", "liste des cartes",
    "table des illustrations",
)
#: The forms of a part divider and of an imprint line.
PART_DIVIDER = r"(?i)^(?:teil|part|partie|section|abschnitt)\b[\s.:]*(?:[0-9]+|[ivxlcdm]+)?\b"
IMPRINT = r"(?i)^\s*[©@]\s*\d{4}\b|^\s*isbn\b|^\s*gedruckt\b|^\s*printed in\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def strip_title(text: Column) -> Column:
    """Without blanks and dots at both ends."""
    return F.regexp_replace(text, r"^[ .]+|[ .]+$", "")


def lines(text: Column) -> Column:
    """A text's lines; none after a last line break, none at all for an empty text."""
    split = F.split(text, r"\R")
    whole = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return F.when(F.length(text) > 0, whole).otherwise(F.array().cast("array<string>"))


def is_url_line(line: Column) -> Column:
    return F.lower(line).rlike(r"doi\.org|http://|https://|www\.")


def is_imprint_line(line: Column) -> Column:
    return line.rlike(IMPRINT)


def plain_title(title: Column) -> Column:
    """Lower case without accents and punctuation, single blanks between words.

    Letters of the Latin-1 and Latin Extended-A blocks lose their accents; other scripts stay as they are.
    """
    accented = "àáâãäåāăąçćĉċčèéêëēĕėęěìíîïĩīĭįñńņňòóôõöōŏőùúûüũūŭůűýÿŷśŝşšźżžďťřŕ"
    base = "aaaaaaaaaccccceeeeeeeeeiiiiiiiinnnnoooooooouuuuuuuuuyyysssszzzdtrr"
    letters = F.translate(F.lower(title), accented, base)
    return F.trim(F.regexp_replace(F.regexp_replace(letters, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def is_part_divider(title: Column) -> Column:
    return title.rlike(PART_DIVIDER)


def is_back_matter(title: Column, normal=plain_title) -> Column:
    form = normal(title)
    before_author = F.trim(F.element_at(F.split(form, r"\b(?:par|by)\b"), 1))
    return form.isin(*BACK_MATTER) | before_author.isin(*BACK_MATTER)


def is_production_bookmark(title: Column, normal=plain_title) -> Column:
    form = normal(title)
    return form.isin(*PRODUCTION) | form.endswith("verzeichnis")


def is_structural(title: Column) -> Column:
    """Parts, lists and production pages: they bound their neighbours and are never chapters."""
    return is_part_divider(title) | is_back_matter(title) | is_production_bookmark(title)


def year_of(date: Column) -> Column:
    """The first token of four digits between blanks or hyphens."""
    tokens = F.filter(F.split(date, r"[-\s]+"), lambda t: t.rlike(r"^\d{4}$"))
    return F.get(tokens, F.lit(0)).cast("int")


def header_form(line: Column) -> Column:
    """A line without digits, blanks squeezed, lower-cased: equal for a running header on every page."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(line, r"(?U)\d+", ""), r"(?U)\s+", " ")))


def normalize_isbn(raw: Column) -> Column:
    """The first 13-digit ISBN of a list, else the first 10-digit one."""
    forms = F.transform(F.split(raw, r"[;\s]+"), lambda t: F.upper(F.regexp_replace(t, "-", "")))
    long = F.filter(forms, lambda t: t.rlike(r"^\d{13}$"))
    short = F.filter(forms, lambda t: t.rlike(r"^\d{9}[\dX]$"))
    return F.coalesce(F.get(long, F.lit(0)), F.get(short, F.lit(0)))


#: A number of one to four digits or a strict roman numeral below five hundred, and a heading's keyword.
NUMERAL = r"(?i)^[0-9]{1,4}$|^(?=.)(cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
HEADING = r"(?i)^(?:chapter|kapitel|chapitre|part|teil|partie|§)\.?(?:\s+(\S+))?$"
#: Letters of the longest number.
NUMERAL_LENGTH = 12
#: What every heading line looks like before anything is stripped.
HEADING_SHAPE = r"(?iU)^\s*+(?:[0-9ivxlcd]{1,12}|(?:chapter|kapitel|chapitre|partie|part|teil|§)\.?(?:\s+[0-9ivxlcd]{1,12})?)\s*+[.:]*+\s*+$"


def is_heading_line(text: Column) -> Column:
    """A heading keyword alone or with a number, or a number alone; closing dots and colons don't count.

    Few lines begin and end as one does, and only those are stripped and taken apart.
    """
    bare = strip(F.regexp_replace(strip(text), "[.:]+$", ""))
    number = F.regexp_extract(bare, HEADING, 1)
    full = bare.rlike(NUMERAL) | (bare.rlike(HEADING) & ((number == "") | number.rlike(NUMERAL)))
    return F.when(text.rlike(HEADING_SHAPE), full).when(text.isNotNull(), False)


def ends_in_number(text: Column) -> Column:
    """Whether the last word is a number; of a long line only its end is looked at, as no number is longer than that."""
    bare = F.when(F.right(text, F.lit(1)).rlike(r"(?U)\s"), strip(text)).otherwise(text)
    return F.element_at(F.split(F.right(bare, F.lit(NUMERAL_LENGTH + 1)), r"(?U)\s+"), -1).rlike(NUMERAL)


#: Installed recognition packs by language, and what is used for all others.
OCR_PACKS = {"de": "deu", "fr": "fra", "es": "spa", "en": "eng"}
OCR_DEFAULT = "eng+deu+fra+spa"


def ocr_pack(language: Column) -> Column:
    """Recognition pack of a catalog's language tag."""
    found = F.lit(OCR_DEFAULT)
    for code, pack in OCR_PACKS.items():
        found = F.when(F.lower(F.split_part(language, F.lit("-"), F.lit(1))) == code, pack).otherwise(found)
    return found


def failure_class(message: Column) -> Column:
    """Bucket of an error message of a model call."""
    low = F.lower(message)
    too_long = low.contains("context length") | low.contains("maximum context")
    broken = low.contains("json array found") | low.contains("expecting")
    return F.when(too_long, "context_length_exceeded").when(broken, "invalid_or_truncated_json").otherwise("api_error")


def extract_json(text: Column, kind: str = "array") -> Column:
    """The outermost JSON array or object in a model's answer, without code fences; null if there is none."""
    opening, closing = ("\\[", "\\]") if kind == "array" else ("\\{", "\\}")
    unfenced = F.regexp_replace(text, r"(?m)^\s*```.*$", "")
    found = F.regexp_extract(unfenced, f"(?s){opening}.*{closing}", 0)
    return F.when(found != "", found)


def license_url(licenses: Column) -> Column:
    """Of (URL, content-version, delay-in-days) the version of record without delay, else the first."""
    final = F.filter(licenses, lambda x: (x["content_version"] == "vor") & (F.coalesce(x["delay"], F.lit(0)) == 0))
    return F.coalesce(F.get(final, F.lit(0))["url"], F.get(licenses, F.lit(0))["url"])


#: License codes of open-access services and the licenses' addresses.
LICENSE_URLS = {
    "cc-by": "https://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa": "https://creativecommons.org/licenses/by-sa/4.0/",
    "cc-by-nd": "https://creativecommons.org/licenses/by-nd/4.0/",
    "cc-by-nc": "https://creativecommons.org/licenses/by-nc/4.0/",
    "cc-by-nc-sa": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "cc-by-nc-nd": "https://creativecommons.org/licenses/by-nc-nd/4.0/",
    "cc0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "pd": "https://creativecommons.org/publicdomain/mark/1.0/",
}


def license_code_url(code: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, url in LICENSE_URLS.items():
        found = F.when(F.lower(code) == name, url).otherwise(found)
    return found
