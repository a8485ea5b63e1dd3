"""Word lists of our own by language and section, and the patterns made of them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms by section and language.
TERMS = {
    "remote": {"en": ["fully remote", "remote", "work from home", "home based"], "de": ["homeoffice", "ortsunabhängig", "von zuhause"], "fr": ["télétravail", "à distance"], "es": ["teletrabajo", "a distancia", "en remoto"]},
    "on_site": {"en": ["on-site", "onsite", "in the office", "office based"], "de": ["vor ort", "im büro"], "fr": ["sur site", "au bureau"], "es": ["presencial", "en la oficina"]},
    "not_remote": {"en": ["no remote", "not remote", "remote is not possible"], "de": ["kein homeoffice"], "fr": ["pas de télétravail"], "es": ["sin teletrabajo"]},
    "hedge": {"en": ["occasionally", "partly", "up to", "possible after"], "de": ["teilweise", "gelegentlich"], "fr": ["partiel", "occasionnel"], "es": ["parcial", "ocasional"]},
    "language_required": {"en": ["fluent german", "fluent french", "native spanish"], "de": ["deutschkenntnisse", "fließend deutsch"], "fr": ["français courant"], "es": ["español nativo"]},
    "english": {"en": ["english"], "de": ["englisch"], "fr": ["anglais"], "es": ["inglés"]},
    "no_sponsorship": {"en": ["no visa sponsorship", "cannot sponsor", "unable to sponsor", "without sponsorship"], "de": ["kein visum"], "fr": ["pas de visa"], "es": ["sin visado"]},
    "unpaid": {"en": ["unpaid", "no salary", "volunteer position"], "de": ["unbezahlt", "ehrenamtlich"], "fr": ["non rémunéré", "bénévole"], "es": ["no remunerado", "voluntario"]},
    "senior": {"en": ["senior", "lead", "principal", "head of"], "de": ["leitung", "leiter"], "fr": ["confirmé", "chef"], "es": ["responsable", "jefe"]},
    "suspicious": {"en": ["wire transfer", "quick money", "no experience needed", "earn from home"], "de": ["schnelles geld"], "fr": ["argent facile"], "es": ["dinero fácil"]},
    "gone": {"en": ["no longer available", "position has been filled", "job not found", "expired"], "de": ["nicht mehr verfügbar"], "fr": ["plus disponible"], "es": ["ya no está disponible"]},
    "posting": {"en": ["requirements", "responsibilities", "apply", "experience", "salary"], "de": ["aufgaben", "anforderungen", "bewerbung"], "fr": ["missions", "profil", "candidature"], "es": ["requisitos", "funciones", "candidatura"]},
    "thesis": {"en": ["master thesis", "thesis"], "de": ["masterarbeit", "abschlussarbeit"], "fr": ["mémoire"], "es": ["tesis"]},
    "internship": {"en": ["internship", "intern"], "de": ["praktikum", "praktikant"], "fr": ["stage", "stagiaire"], "es": ["prácticas", "becario"]},
    "phd": {"en": ["phd", "doctoral"], "de": ["doktorand", "promotion"], "fr": ["doctorat"], "es": ["doctorado"]},
    "part_time": {"en": ["part-time", "part time"], "de": ["teilzeit"], "fr": ["temps partiel"], "es": ["media jornada"]},
}
#: Frequent function words, by which short texts are told apart.
MARKERS = {
    "en": "the and of to in is that with for this are from was it be".split(),
    "de": "der die das und ist nicht mit für von den zu ein eine dem auf".split(),
    "fr": "le la les et des une est dans pour que qui sur pas au du".split(),
    "es": "el los las y del una es para que por con su como se no".split(),
}
COUNTRY_LANGUAGE = {"United Kingdom": "en", "Germany": "de", "France": "fr", "Spain": "es"}
PLACES = {"London": "United Kingdom", "Leeds": "United Kingdom", "Berlin": "Germany", "Munich": "Germany", "Paris": "France", "Lyon": "France", "Madrid": "Spain", "Sevilla": "Spain"}


def folded(term: str) -> str:
    """A term without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def terms_of(section: str, languages: list[str] | None = None) -> list[str]:
    """The section's terms in the languages (all if None), with their spellings without accents, longest first."""
    chosen = [t for lang, ts in TERMS[section].items() if languages is None or lang in languages for t in ts]
    return sorted({x for t in chosen for x in (t, folded(t))}, key=lambda t: (-len(t), t))


def pattern_of(terms: list[str]) -> str:
    """Terms at the start of a word; those of up to three letters also end with one. RE2 and Java read it alike."""
    ends = r"(?:$|[^\p{L}\p{N}_])"
    parts = [re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", t) + (ends if len(t) <= 3 else "") for t in terms]
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(parts) + ")"


def hit(text: Column, section: str, languages: list[str] | None = None) -> Column:
    """Whether a lower-cased text holds a term of the section."""
    return text.rlike(pattern_of(terms_of(section, languages)))


def hit_by_language(text: Column, language: Column, section: str) -> Column:
    """As ``hit``, in the row's language and English; rows of no known language are read in all of them."""
    out = F.when(F.lit(False), F.lit(False))
    for lang in TERMS[section]:
        out = out.when(language == lang, hit(text, section, sorted({lang, "en"})))
    return out.otherwise(hit(text, section))


def sql_hit(text: str, section: str, languages: list[str] | None = None) -> str:
    """The same test as DuckDB SQL."""
    pattern = pattern_of(terms_of(section, languages)).replace("'", "''")
    return f"regexp_matches({text}, '{pattern}')"


def sql_hit_by_language(text: str, language: str, section: str) -> str:
    cases = " ".join(f"WHEN {language} = '{lang}' THEN {sql_hit(text, section, sorted({lang, 'en'}))}" for lang in TERMS[section])
    return f"CASE {cases} ELSE {sql_hit(text, section)} END"
