"""Personal information inside free text.

Weak supervision. Patterns propose spans of five kinds; labelers of three sorts
then vote on each span, for, against or not at all: strict patterns,
gazetteers (words of streets, given names, numbers' uses) and context (the words
round the span, the key that holds it). Nobody labels anything by hand: for
each kind, expectation-maximisation over how often each pattern of votes occurs
estimates how reliable each labeler is and how probable each span. A logistic
classifier trained on these probabilities, which also sees the shape of the
span and the sort of key, decides. Training sees counts of all spans, summed up
by votes and features, so what reaches the driver doesn't grow with the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.names import NICKNAMES, SUFFIXES, TITLES
from rosterlake.session import materialise

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "street_address": "<ADDRESS>", "person_name": "<NAME>"}
LABELERS = 5

#: Keys under which the candidate's own name stands.
NAME_KEYS = frozenset("name full_name fullName fullname candidate_name candidateName displayName display_name username person applicant".split())

# ---- spans: what may be an item ----------------------------------------------------------------------------------
_LOCAL, _SPELT_DOT = r"[\w.+*•%-]{1,64}", r"(?:\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s+(?:dot|DOT)\s+)"
_PLAIN_MAIL = re.compile(r"[\w.+*•%-]{1,64}@[\w*-]{1,63}(?:\.[\w*-]{1,63})+")
#: An address, plain, with spaces round the sign, or spelt out: the sign, the dots or both.
_SPELT_MAIL = re.compile(
    rf"{_LOCAL}(?:\s?@\s?|\s?[(\[{{]\s?(?:at|AT|@)\s?[)\]}}]\s?)[\w*-]{{1,63}}(?:(?:\.|{_SPELT_DOT})[\w*-]{{1,63}})*(?:\.|{_SPELT_DOT})[A-Za-z]{{2,}}"
    rf"|{_LOCAL}\s+(?:at|AT)\s+[\w*-]{{1,63}}(?:\.[\w*-]{{1,63}})*(?:{_SPELT_DOT}[\w*-]{{1,63}})*(?:\.|{_SPELT_DOT})[A-Za-z]{{2,}}"
)
_PHONE = re.compile(
    r"(?<![\w.@/#-])(?:"
    r"(?:\+|00)\d{1,3}[\s.-]?(?:\(0?\)?\d{0,4}\)?[\s.-]?)?\d{1,5}(?:[\s./-]?\d{2,5}){1,4}"
    r"|\(\d{2,5}\)[\s.-]?\d{3,4}[\s.-]?\d{3,5}"
    r"|\d{3}[-.\s]\d{3}[-.\s]\d{4}"
    r"|0\d{1,4}(?:[\s./-]?\d{2,8}){1,5}"
    r"|\d{10,13}"
    r")(?:\s?(?:ext|x|extension)\.?\s?\d{1,5})?(?![\w@])(?!\.\d)", re.I
)
_ID = re.compile(
    r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{4}[ -]\d{4}[ -]\d{4}|\d{6}-[1-8]\d{6}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[XYZ]?\d{7,8}-?[A-Z]|[A-Z]{1,2}\d{6,8}|\d{9}|\d{12}|\d{3}\.\d{3}\.\d{3}-\d{2}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\w-])(?!\.\d)"
)
_UP = r"A-ZÀ-ÖØ-ÞŁŠŽ"
_CAP = rf"[{_UP}](?:[^\W\d_]|['’-])+"
#: Words of street names by language.
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Way|Terrace|Gardens?|Place|Pl|Square|Sq|Boulevard|Blvd|Crescent|Row|Walk|Hill|Mews|Grove|Park|Parade|Quay|Highway|Parkway|Alley)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|No)\.?\s?\w{1,5},?\s+)"
_ADDRESS = re.compile(
    rf"{_UNIT}?(?<![\w.-])\d{{1,5}}[a-z]?,?\s+(?:{_CAP}\s+){{1,3}}{_STREET}\b\.?(?:,?\s+(?:Flat|Apt|Apartment|Unit|Suite)\.?\s?\w{{1,5}})?"
    rf"|\b(?:{_CAP}[\s-])?[{_UP}]?\w*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|laan|straat|plein|gracht|kade)\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|(?<![\w.-])\d{{1,4}}(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?[\w'’-]+(?:\s+{_CAP})?"
    rf"|\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Rua|Travessa|Praça|Via|Viale|Piazza|Corso)\s?(?:(?:de|da|do|del|la|las|los|dos|das)\s+)*{_CAP}(?:\s+{_CAP})?,?\s+(?:n[.ºo°]*\s?)?\d{{1,4}}\b"
    rf"|\b(?:ул\.|улица|проспект|пр\.)\s+[А-ЯЁ][\w-]+,?\s+(?:д\.\s?)?\d{{1,4}}"
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Ing|Herr|Frau|Sr|Sra|Señor|Señora|Mme|M|Dhr|Mevr|Sir|Dame)"
_NAME = rf"(?:{_CAP}\s+(?:[{_UP}]\.?\s+)?{_CAP}|[{_UP}]\.\s?{_CAP}|{_CAP},\s?(?:{_CAP}|[{_UP}]\.))"
_PERSON = re.compile(
    rf"\b{_TITLE}\.?\s+(?:[{_UP}]\.\s?)?{_CAP}(?:\s+{_CAP})?|\b{_NAME}"
)
_LEAD = re.compile(
    r"(?:\b(?:ask(?:ed)?|referred by|led by|worked (?:next to|with|for|under)|next to|manager (?:was|is)|reports? to|reported to|contact person:?|reference:?|referee:?|recommended by|introduced by|mentored by|hired by|spoke (?:to|with)|supervised by|signed by|met|thanks to))\s+$", re.I
)
_TRAIL = re.compile(r"^\s*(?:vouch(?:es|ed)|recommend(?:s|ed)?|refer(?:s|red)|introduced|mentor(?:s|ed)|supervise[sd]|can confirm|confirm(?:s|ed))", re.I)
_HINT = re.compile(r"vouch|refer|\bled by\b|next to|manager|\bask|report|recommend|introduc|mentor|spoke|supervis|\bmet\b|thanks to|hired by|signed by|worked (?:with|for|under)\b|contact person|confirm|\b(?:M[rsx]s?|Dr|Prof|Ing|Miss|Mx|Herr|Frau|Sra?|Señora?|Mme|M|Dhr|Mevr|Sir|Dame)\b\.?\s", re.I)
_CAPITAL = re.compile(_CAP)
_ORG = re.compile(r"\b(?:Labs?|Systems|Media|Works|Freight|Studios?|Robotics|Analytics|Insurance|Logistics|Foods|Energy|Health|Retail|Networks|Payments|Materials|Mobility|Aerospace|Insight|University|Institute|College|GmbH|Ltd|Inc|Group|Partners|Services|Careers|Advisory|Selection|Resourcing|Associate|Practitioner|Expert|Street|Road|Avenue|Lane)\b")
_STOP = frozenset(
    "the a an it they their in at on of most what since before during latency colleagues someone we room order ticket invoice build port commit iso req ping ran kept owned joined within copied onboarding background form lists "
    "mail write best contact home send moved lives call mobile tel whatsapp ring direct line interview worked referred ask cv ref passport aadhaar pan dni ssn looking lead senior freelance met mit with avec con".split()
)

# Cheap tests, each true of every text in which the pattern it stands before can match; _HINT of every text with a cue or a title.
_DIGIT = re.compile(r"\d")
_AT_HINT = re.compile(r"@|[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:at|AT)\s+[\w*-]+(?:\.|\s*[(\[{]\s?(?:dot|DOT)|\s+(?:dot|DOT)\s)")
_NUMBER_HINT = re.compile(r"(?:\d[\s()./+-]{0,3}){6}|[A-Z]{2,5}\d{4}|[A-Z]{2} ?\d{2} ?\d{2}|\d{3}[-.]\d{2,3}[-.]")
_STREET_HINT = re.compile(rf"{_STREET}\b|stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|laan|straat|plein|gracht|kade|\b(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|Calle|C/|Avenida|Avda|Plaza|Paseo|Rua|Travessa|Praça|Via|Viale|Piazza|Corso)|улица|ул\.|проспект|пр\.")

_AT_PARTS = ("@", " at ", " AT ", "at)", "at]", "at}", "AT)", "AT]", "AT}", "at )", "at ]", "AT )", "AT ]", "\xa0at", "\tat", "\nat")
_HINT_PARTS = ("vouch", "refer", "led by", "next to", "manager", "ask", "report", "recommend", "confirm", "introduc", "mentor", "spoke", "supervis", "met", "thanks to", "hired by", "signed by", "worked ", "contact person")
_TITLE_PARTS = ("Mr", "Ms", "Dr", "Prof", "Ing", "Miss", "Mx", "Herr", "Frau", "Sr", "Señor", "Mme", "M ", "M.", "Dhr", "Mevr", "Sir", "Dame")


def _any(parts: tuple[str, ...], text: str) -> bool:
    for p in parts:  # noqa: SIM110 - a loop is twice as fast as any() here
        if p in text:
            return True
    return False


# ---- labelers ----------------------------------------------------------------------------------------------------
_MAIL_WORDS = re.compile(r"(?:e-?mail|mail|write|contact|reach|cv sent|address|inbox|under)\b[^@]{0,25}$", re.I)
_PHONE_WORDS = re.compile(r"(?:call|phone|tel|mobile|cell|whatsapp|ring|line|number|ph|fax|sms|dial|text|office)\b[^\d]{0,18}$", re.I)
_ID_WORDS = re.compile(
    r"\b(?:ssn|soc(?:ial|\.)?\s?sec(?:urity|\.)?|aadhaar|aadhar|pan|dni|nie|nif|cpf|bsn|rrn|nino|ni number|national insurance|tax(?: ?id|payer)?|tin|passport|travel document|national id|identity|id card|personal number|steuer-?id|ausweis|my ?number|insee)\b[^\d]{0,22}$", re.I
)
_OTHER_NUMBER = re.compile(r"\b(?:order|invoice|ticket|build|port|room|commit|iso|soc 2|req|version|section|case|release|ref|sku|isbn|part|model|file|run|grade|inc)\b[\s.:#-]{0,3}(?:no\.?\s?)?[A-Z-]*$", re.I)
_COUNTED = re.compile(r"^\s*(?:rows|files|records|percent|%|ms|people|sites|hours|months|years|per\b|users|requests|bytes|gb|mb|kb|eur|usd|gbp)", re.I)
_KEY_SORTS = (
    ("email", re.compile(r"e?-?mail", re.I)), ("phone", re.compile(r"phone|mobile|^tel|fax|cell|whatsapp|^number$", re.I)),
    ("id", re.compile(r"ssn|passport|national|tax|aadhaar|^pan$|^dni$|identity|gov", re.I)), ("address", re.compile(r"address|street|^line\d?$", re.I)),
    ("person", re.compile(r"^name$|referee|reference|people|manager|contact_?person|author|interviewer", re.I)),
    ("money", re.compile(r"(?:^|_)(?:salary|pay|amount|wage|rate)s?(?:_|$)")), ("link", re.compile(r"url|link|portfolio|website|github|profile|site|handle|user", re.I)),
    ("code", re.compile(r"(?:^|_)(?:hash|ref|flag|rank|run|scraped|crawler|id|code|version|year|lvl|month)s?(?:_|$)")),
    ("label", re.compile(r"(?:^|_)(?:company|school|degree|role|title|skill|stack|main|also|certif\w*|location|city|country|place|language|level|position|headline|zone|tag|field)s?(?:_|$)")),
)


@lru_cache(maxsize=10_000)
def key_sort(key: str) -> str:
    """The sort of a key, text if its name says nothing. Money, codes and labels are known by whole words of the key."""
    words = re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", "_", key).lower()
    for sort, pattern in _KEY_SORTS:
        if pattern.search(words if sort in ("money", "code", "label") else key):
            return sort
    return "text"


_FORMAL = frozenset(w for line in NICKNAMES.replace("\n", " ").split(";") for w in line.split())


class Finder:
    """Spans with votes and features of one text. ``given`` are the gazetteer's given names, in lower case."""

    def __init__(self, given: frozenset[str]):
        self.given = given | _FORMAL

    def spans(self, text: str, key: str, parent: str, own_name: bool) -> Iterator[tuple[str, int, int, tuple[int, ...], str]]:
        """(kind, start, end, votes, features) of what may be an item."""
        sort = key_sort(key)
        if sort == "text" and parent:
            sort = "person" if key in ("full_name", "fullName") else sort
        taken: list[tuple[int, int]] = []
        if _any(_AT_PARTS, text) and _AT_HINT.search(text):
            for m in _SPELT_MAIL.finditer(text):
                span = m.span()
                whole = _PLAIN_MAIL.fullmatch(m.group()) is not None
                spelt = not whole and bool(re.search(r"\bdot\b|[(\[{]|@", m.group(), re.I))
                end = re.sub(r".*[.\s)\]}]", "", m.group())
                before = text[max(0, span[0] - 30) : span[0]]
                yield self._out("email", span, (1 if whole else 0, 1 if spelt else (-1 if not whole else 0), 1 if end.isalpha() and len(end) >= 2 else -1, 1 if sort == "email" else (-1 if sort in ("link", "code") else 0), 1 if _MAIL_WORDS.search(before) else 0), sort, m.group())
                taken.append(span)
        if _DIGIT.search(text):
            if _NUMBER_HINT.search(text):
                yield from self._numbers(text, sort, taken)
            for m in _ADDRESS.finditer(text) if _STREET_HINT.search(text) else ():
                before = text[max(0, m.start() - 40) : m.start()]
                street = bool(re.search(rf"\b{_STREET}\b|stra(?:ß|ss)e|weg|gasse|platz|rue|calle|c/|avenida|rua", m.group(), re.I))
                yield self._out("street_address", m.span(), (1, 1 if street else 0, 1 if sort == "address" else (-1 if sort in ("link", "code", "money") else 0), 1 if re.search(r"(?:lives|address|office|home|contract to|moved from|send|at|am|in)\b[^.]{0,22}$", before, re.I) else 0, -1 if _COUNTED.match(text[m.end() :]) else 0), sort, m.group())
        if sort == "person":
            yield from self._people(text, sort, taken, own_name, True)
        elif "," in text or "." in text or len(text.split(None, 1)) > 1:  # true of every text with a name
            hint = (_any(_TITLE_PARTS, text) or _any(_HINT_PARTS, text.lower())) and _HINT.search(text) is not None
            if hint or not self.given.isdisjoint([w.lower() for w in _CAPITAL.findall(text)]):
                yield from self._people(text, sort, taken, own_name, hint)

    def _numbers(self, text: str, sort: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
        ids: list[tuple[int, int]] = []
        for m in _ID.finditer(text):
            if _overlaps(m.span(), taken):
                continue
            before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 14]
            named = bool(_ID_WORDS.search(before))
            strict = bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{4}[ -]\d{4}[ -]\d{4}|\d{6}-[1-8]\d{6}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|\d{8}[A-Z]", m.group()))
            against = bool(_OTHER_NUMBER.search(before) or _COUNTED.match(after))
            wrong = sort in ("phone", "money", "link", "code", "email")
            votes = (1 if strict else 0, 1 if named else -1 if not strict else 0, -1 if against else 0, -1 if wrong else (1 if sort == "id" else 0), -1 if _PHONE_WORDS.search(before) and not named else 0)
            yield self._out("id_number", m.span(), votes, sort, m.group())
            if named or strict and not wrong:
                ids.append(m.span())
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in re.sub(r"(?:ext|x|extension)\.?\s?\d+$", "", m.group(), flags=re.I))
            if digits < 7 or digits > 15 or _overlaps(m.span(), taken) or _overlaps(m.span(), ids):
                continue
            before, after = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 14]
            formatted = bool(re.match(r"\+|00\d|\(|0\d", m.group())) or bool(re.match(r"\d{3}[-. ]\d{3}[-. ]\d{4}", m.group()))
            against = bool(_OTHER_NUMBER.search(before) or _COUNTED.match(after))
            votes = (1 if formatted else 0, 1 if _PHONE_WORDS.search(before) else 0, 1 if sort == "phone" else (-1 if sort in ("money", "link", "code") else 0), -1 if against or _ID_WORDS.search(before) else 0, 1 if 10 <= digits <= 14 else -1)
            yield self._out("phone", m.span(), votes, sort, m.group())

    def _people(self, text: str, sort: str, taken: list[tuple[int, int]], own_name: bool, hint: bool) -> Iterator[tuple]:
        """Every match is proposed that any labeler votes for; one without a given name, a title or a cue has no vote but those against it."""
        if own_name:
            return
        at = 0
        while (m := _PERSON.search(text, at)) is not None:
            start, end = m.span()
            at = end
            words = re.findall(rf"{_CAP}|[{_UP}]\b", m.group())
            if words and len(words[0]) > 1 and words[0].lower() in _STOP and not re.match(rf"{_TITLE}\b", m.group()):
                at = start + len(words[0])
                continue
            if _overlaps((start, end), taken):
                continue
            before, after = text[max(0, start - 30) : start], text[end : end + 30]
            title = bool(re.match(rf"{_TITLE}\b\.?\s", m.group()))
            known = any(w.lower() in self.given for w in words)
            org = bool(_ORG.search(m.group()) or _ORG.match(after.lstrip()))
            lead = bool(_LEAD.search(before) or _TRAIL.match(after))
            shaped = bool(re.match(rf"[{_UP}]\.|{_CAP},", m.group())) and (lead or sort == "person")
            # without a cue, a given name in a list of words or in the name of something else says nothing
            full = known and not org and not re.match(rf"{_CAP},", m.group())
            if full and not (lead or title or sort == "person") and len(words[0]) > 1 and words[0].lower() not in self.given:
                # the word that begins a sentence, before a given name
                at = start + len(words[0])
                continue
            if not (hint or full or title or lead):
                continue
            told = sort == "text" or sort != "person" and (lead or title)  # with a cue it is prose, whatever the key
            votes = (1 if title else 0, 1 if known and (hint or full) else (0 if title or shaped or sort == "person" else -1), 1 if lead else 0 if sort == "person" or title or full else -1, 1 if sort == "person" else 0 if told else -1, -1 if org else 0)
            yield self._out("person_name", (start, end), votes, "text" if told else sort, m.group())
        if sort == "person" and not _PERSON.search(text) and re.search(r"[^\W\d_]{2}", text):
            # a name key whose value isn't shaped like a name in prose: lower case or one word
            known = any(w in self.given for w in re.findall(r"[^\W\d_]+", text.lower()))
            yield self._out("person_name", (0, len(text)), (0, 1 if known else 0, 0, 1, -1 if _ORG.search(text) else 0), sort, text)

    @staticmethod
    def _out(kind: str, span: tuple[int, int], votes: tuple[int, ...], sort: str, text: str) -> tuple[str, int, int, tuple[int, ...], str]:
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text[:24])))[:8]
        return kind, span[0], span[1], votes, f"{sort}|{shape if kind in ('phone', 'id_number') else len(text).bit_length()}"


def _overlaps(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    return any(span[0] < e and s < span[1] for s, e in taken)


_REDACTED = re.compile(r"<[A-Z_]+_REDACTED>|\[[A-Za-z]+ (?:Redacted|Omitted)\]")


def _leaves(record: dict) -> Iterator[tuple[str, str, str, object]]:
    """(path, key, parent key, value) of every string and number; objects under a person's key pass their key on."""
    stack: list[tuple[str, str, str, object]] = [(k, k, "", v) for k, v in reversed(record.items())]
    while stack:
        path, key, parent, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", k, key, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", key, parent, x) for i, x in reversed(list(enumerate(v))))
        elif isinstance(v, str) or isinstance(v, (int, float)) and not isinstance(v, bool):
            yield path, key, parent, v


_SPANS = "id string, row bigint, place string, kind string, start int, stop int, votes int, features string"
_LINK = re.compile(r"\S*://\S*")


def gazetteer(df: DataFrame, name: str = "name", fewest: int = 6, share: float = 1 / 20_000) -> frozenset[str]:
    """Given names: words that stand first or last in names beside many different others.

    A word counts if it stands in at least ``fewest`` different names and in
    ``share`` of them all; family names stand in few. Counts cover all names. A
    name has at most three words, so there are at most 3 / ``share`` such
    words, however many names.
    """
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([^\W\d_]{3,})"), 1)
    pairs = df.select(F.array_distinct(words).alias("w")).filter(F.size("w").between(2, 3)).distinct()
    one = pairs.select(F.explode("w").alias("word"), F.concat_ws(" ", "w").alias("with"))
    often = materialise(one.groupBy("word").agg(F.count("*").alias("n")), "name_words")
    names = (often.agg(F.sum("n")).first()[0] or 0) / 2
    return frozenset(r["word"] for r in often.filter(F.col("n") >= max(fewest, share * names)).collect()) - TITLES - SUFFIXES


def spans(df: DataFrame, given: frozenset[str], key: str = "id", name: str = "name", headline: str = "headline", source: str = "source") -> DataFrame:
    """(id, row, place, kind, start, stop, votes, features) of every span that may be an item; ``row`` is a hash of the row's four values.

    Numbers are read as they are written. Null values, and sources that aren't
    JSON objects, give nothing; what is redacted already is no item.
    """
    shared = df.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            out: list[tuple] = []

            def look(whose: tuple, place: str, text: str, key: str, parent: str, own: bool) -> None:
                for kind, start, stop, votes, features in finder.spans(text, key, parent, own):
                    code = 0
                    for v in votes:
                        code = code * 3 + v + 1
                    out.append((*whose, place, kind, start, stop, code, features))

            for cid, n, h, text, row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if cid is None:
                    continue
                whose = cid, row
                if n:
                    look(whose, "name", n, "display", "", True)
                if h:
                    look(whose, "headline", h, "prose", "", False)
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                for path, k, parent, v in _leaves(record):
                    if not isinstance(v, str):
                        if abs(v) < 1_000_000 or isinstance(v, float) and not v.is_integer():
                            continue  # no item is a number of fewer than seven digits, or one with a fraction
                        v = str(int(v))
                    elif ("REDACTED" in v or " Redacted]" in v or " Omitted]" in v) and _REDACTED.search(v):
                        v = _REDACTED.sub(lambda m: " " * len(m.group()), v)
                    own, sort = not parent and k in NAME_KEYS, key_sort(k)
                    prose = sort == "label" and parent == ""
                    if "://" in v:  # a link is no item; what stands beside it is prose
                        v = _LINK.sub(lambda m: " " * len(m.group()), v)
                        prose = prose or sort == "link"
                    look(whose, "source." + path, v, "prose" if prose else k, parent, own)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _SPANS.split(", ")])

    columns = [F.col(c).cast("string") for c in (key, name, headline, source)]
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.xxhash64(*columns).alias("row")).mapInArrow(run, _SPANS)


# ---- reliabilities and the classifier ----------------------------------------------------------------------------
def _votes(code: np.ndarray) -> np.ndarray:
    out = np.empty((len(code), LABELERS), int)
    for j in range(LABELERS - 1, -1, -1):
        out[:, j] = code % 3 - 1
        code = code // 3
    return out


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each row, table of P(vote | class, it votes) by labeler) by expectation-maximisation.

    ``votes`` holds -1, 0 or 1 per labeler and ``n`` how often the row occurs.
    A labeler that doesn't vote says nothing. It starts from the balance of
    votes; pseudo-counts keep each labeler on the side that its votes are meant
    for.
    """
    p = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1)))
    prior = np.array([[4.0, 1.0], [1.0, 4.0]])  # of -1 and 1 in the classes no and yes
    weight = 0.02 * n.sum() + 5
    table = np.zeros((votes.shape[1], 2, 2))
    for _ in range(rounds):
        share = ((p * n).sum() + 1) / (n.sum() + 2)
        odds = np.full(len(n), np.log(share / (1 - share)).clip(-1, 1))
        for j in range(votes.shape[1]):
            for k, v in enumerate((-1, 1)):
                at = votes[:, j] == v
                table[j, :, k] = ((1 - p) * n)[at].sum(), (p * n)[at].sum()
            table[j] += weight * prior / prior.sum(axis=1, keepdims=True)
            table[j] /= table[j].sum(axis=1, keepdims=True)
            for k, v in enumerate((-1, 1)):
                odds[votes[:, j] == v] += np.log(table[j, 1, k] / table[j, 0, k])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, table


def classifier(votes: np.ndarray, features: list[str], p: np.ndarray, n: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Probability of each row by a logistic model of its votes and features, fitted to ``p`` with weights ``n``."""
    names: dict[str, int] = {}
    rows = []
    for v, f in zip(votes, features, strict=True):
        sort, _, shape = f.partition("|")
        keys = ["bias", "sort " + sort, "shape " + shape, *(f"vote {j} {x}" for j, x in enumerate(v) if x)]
        rows.append([names.setdefault(k, len(names)) for k in keys])
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, weight = np.zeros(len(names)), n / n.sum()
    step = np.zeros(len(names))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - p)) + 1e-4 * w
        step += gradient**2
        w -= 0.5 * gradient / (np.sqrt(step) + 1e-8)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def decide(counts: pd.DataFrame) -> pd.DataFrame:
    """(kind, votes, features, probability) for the counted rows (kind, votes, features, n)."""
    parts = []
    for _, part in counts.groupby("kind"):
        votes, n = _votes(part["votes"].to_numpy(int)), part["n"].to_numpy(float)
        p, _ = reliabilities(votes, n)
        parts.append(part.assign(probability=classifier(votes, part["features"].tolist(), p, n)))
    return pd.concat(parts) if parts else counts.assign(probability=0.0)


_MODEL = "kind string, votes int, features string, n bigint, probability double"


def found_spans(df: DataFrame, key: str = "id", name: str = "name", headline: str = "headline", source: str = "source", least: float = 0.5, most: int = 100_000) -> DataFrame:
    """(id, row, place, kind, start, stop, probability) of the items.

    place is ``name``, ``headline`` or ``source.`` and the path of the string or
    number; ``row`` is a hash of the row that holds it, as rows of one id may
    differ. Null ids, null values and sources that aren't JSON objects give
    nothing; repeated rows give one row; other columns don't matter, whatever
    their names. ``most`` guards the driver: it is far above the number of
    different vote patterns and features that the labelers can make.
    """
    spark = df.sparkSession
    given = gazetteer(df, name)
    every = materialise(spans(df, given, key, name, headline, source), "spans")
    counts = every.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).limit(most + 1).toPandas()
    if len(counts) > most:
        raise ValueError("more vote patterns than the labelers can make")
    model = spark.createDataFrame(decide(counts)[["kind", "votes", "features", "n", "probability"]].values.tolist(), _MODEL)
    good = model.filter(F.col("probability") >= least).drop("n")
    return every.join(F.broadcast(good), ["kind", "votes", "features"]).select("id", "row", "place", "kind", "start", "stop", "probability").distinct()


def redacted(df: DataFrame, items: DataFrame, key: str = "id", name: str = "name", headline: str = "headline", source: str = "source") -> DataFrame:
    """(id, name, headline, source) with the items of :func:`found_spans` replaced by typed placeholders, all else unchanged.

    Each row gives a row, with the items of just that row. Placeholders are put
    into the JSON text as it stands; a number that is an item becomes a string.
    Rows without items, and sources that aren't JSON objects, stay as they are.
    Only an object with a repeated key is written anew, with its last value, as
    the others might hold items that nobody reads.
    """
    lists = items.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("place", "kind", "start", "stop")).alias("__items"))
    columns = [(F.col(c).cast("string"), n) for c, n in ((key, "id"), (name, "name"), (headline, "headline"), (source, "source"))]
    rows = df.select(*[c.alias(n) for c, n in columns], F.xxhash64(*[c for c, _ in columns]).alias("__own"))
    joined = rows.join(lists, F.col("__own") == F.col("__row"), "left").select("id", "name", "headline", "source", "__items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, n, h, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at: dict[str, list] = {}
                for x in found or ():
                    at.setdefault(x["place"], []).append((x["start"], x["stop"], x["kind"]))
                inside = {p[7:]: v for p, v in at.items() if p.startswith("source.")}
                out.append((cid, redact(n, at["name"]) if n and "name" in at else n, redact(h, at["headline"]) if h and "headline" in at else h, redact_json(text, inside) if inside else text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "name", "headline", "source"])

    return joined.mapInArrow(run, "id string, name string, headline string, source string")


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]|[^\s{}\[\],:"]+', re.S)
_LETTER = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.S)


def leaf_places(text: str) -> dict[str, tuple[int, int]] | None:
    """Where in a JSON text the string or number at each path stands, quotes included; None if a key is repeated."""
    places: dict[str, tuple[int, int]] = {}
    stack: list[list] = []  # (path, place in the array or None, key, keys so far)
    for m in _JSON.finditer(text):
        token = m.group()
        top = stack[-1] if stack else None
        if token in "}]":
            stack.pop()
        elif token == ",":
            top[1], top[2] = (None, None) if top[1] is None else (top[1] + 1, None)
        elif top is not None and top[1] is None and top[2] is None and token[0] == '"':
            top[2] = json.loads(token)
            if top[2] in top[3]:
                return None
            top[3].add(top[2])
        else:
            path = "" if top is None else f"{top[0]}[{top[1]}]" if top[1] is not None else f"{top[0]}.{top[2]}" if top[0] else top[2]
            if token in "{[":
                stack.append([path, 0 if token == "[" else None, None, set()])
            else:
                places[path] = m.span()
    return places


def redact_json(text: str, at: dict[str, list]) -> str:
    """The JSON text with the strings and numbers at the given paths redacted, every other character as it was."""
    places = leaf_places(text)
    if places is None:
        record = json.loads(text)
        stack: list[tuple[str, object]] = [("", record)]
        while stack:
            path, v = stack.pop()
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                own = f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k
                if isinstance(x, (dict, list)):
                    stack.append((own, x))
                elif own in at:
                    v[k] = redact(x if isinstance(x, str) else str(int(x)), at[own])
        return json.dumps(record, ensure_ascii=False)
    for path, (start, stop) in sorted(((p, places[p]) for p in at if p in places), key=lambda x: -x[1][0]):
        raw = text[start:stop]
        if raw[0] != '"':
            raw = json.dumps(redact(str(int(json.loads(raw))), at[path]))
        else:
            inner = raw[1:-1]
            if "\\" in inner:  # places count characters, some of which are written as escapes
                edges = [m.start() for m in _LETTER.finditer(inner)] + [len(inner)]
                items = [(edges[a], edges[b], kind) for a, b, kind in at[path]]
            else:
                items = at[path]
            raw = f'"{redact(inner, items)}"'
        text = text[:start] + raw + text[stop:]
    return text


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders; of overlapping items the longer one counts."""
    done: list[tuple[int, int, str]] = []
    for start, stop, kind in sorted(items, key=lambda x: (x[0] - x[1], x[0])):
        if not any(start < e and s < stop for s, e, _ in done):
            done.append((start, stop, kind))
    for start, stop, kind in sorted(done, reverse=True):
        text = text[:start] + PLACEHOLDER[kind] + text[stop:]
    return text
