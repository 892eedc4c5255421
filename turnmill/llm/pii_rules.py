"""Labelled spans of personal information: patterns and cues that name training spans and check decoded ones.

Only what is certain by its form or by a cue next to it. Offsets are code points.
"""

from __future__ import annotations

import re

ENTITIES = ("email", "phone", "national_id", "address", "person")

# Number words of spelled-out numbers.
_DIGIT = (
    r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|"
    r"null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|un)"
)
_SPELLED = re.compile(rf"(?<![\w-])(?:plus[ ,-]+)?{_DIGIT}(?:[ ,-]+(?:(?:double|triple)[ -]+)?{_DIGIT}){{6,15}}(?![\w-])", re.I)
_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]*\s?@\s?[\w-]+(?:\.[\w-]+)+")
_AT = r"(?:\s*(?:\[at\]|\(at\)|\{at\})\s*|\s+(?:at|arroba|arobase)\s+)"
_DOT = r"(?:\s*(?:\[dot\]|\(dot\)|\{dot\})\s*|\s+(?:dot|punto|point|punkt)\s+)"
_JOINT = r"(?:\s+(?:dot|dash|hyphen|minus|underscore|plus|punto|guion|point|tiret|punkt|unterstrich)\s+|\s*(?:\[dot\]|\(dot\))\s*)"
_EMAIL_SPELLED = re.compile(rf"(?<![\w.+@-])(?!(?:me|us|him|her|them|it|is|es|est|ist|to|on|a|an|or)\s)\w[\w.+-]*(?:{_JOINT}\w[\w.+-]*)*(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\s*(?:\[at\]|\(at\)|\{{at\}})\s*[\w-]+(?:\.[\w-]+)+)", re.I)
_BEFORE, _AFTER = r"(?<![\w$€£.,:#/+-])(?<!\d )", r"(?![\w/]|[-.,:]\d| \d)"
_PHONES = re.compile(
    _BEFORE + r"(?:"
    r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}"
    r"|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}"
    r"|\d{3}[-.]\d{3}[-.]\d{4}|\d{3} \d{3} \d{4}"
    r"|0\d{2,3} \d{4} \d{4}|0\d{4} \d{6}|0\d{3} \d{3} \d{4}|0\d{3} \d{7}|0\d{2} \d{5} \d{3}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|[5-9]\d{2} \d{3} \d{3}"
    r"|\d{10}"
    r")" + _AFTER)
_IDS = re.compile(
    _BEFORE + r"(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{4} \d{4} \d{4}|\d{9}|[A-Za-z]{2}\d{6}[A-Za-z]|[A-Za-z]{2} \d{2} \d{2} \d{2} [A-Za-z])" + _AFTER)
_WORD = r"[^\W\d_][\w’'-]+"
_STREET_EN = r"(?:Street|St|Court|Ct|Avenue|Ave|Terrace|Close|Lane|Ln|Row|Road|Rd|Drive|Dr|Blvd|Boulevard|Way|Place|Square|Crescent|Gardens|Grove)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s+\d+\w?,?\s+)?\d{{1,5}}\s?[A-Za-z]?,?\s+(?:(?:[NSEW]|North|South|East|West)\.?\s+)?{_WORD}(?:\s{_WORD})?\s+{_STREET_EN}\b"
    rf"|(?<![\w-])\d{{1,4}}\s?(?:bis|ter|[a-d])?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s+(?:de\s+la\s+|de\s+l['’]|du\s+|des\s+|de\s+|d['’])?{_WORD}"
    rf"|(?<![\w-])(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera|ronda)\s+(?:de\s+la\s+|del\s+|de\s+)?{_WORD}(?:\s{_WORD})?,?\s+(?:n[.º°]\s?)?\d{{1,4}}"
    rf"|(?<![\w-])[^\W\d_][\w’'-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm)\s+\d{{1,4}}\s?[a-z]?\b", re.I)
_LOWER_NAME = r"[^\W\d_][^\W\d_’'-]+(?:-[^\W\d_]{2,})?"
_FULL = rf"(?:[^\W\d_]\.\s+)?{_LOWER_NAME}(?:\s+[^\W\d_]\.)?(?:\s+{_LOWER_NAME})?"
_LISTED = rf"{_LOWER_NAME},\s+(?:{_LOWER_NAME}|[^\W\d_]\.)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Señora?|Sr|Sra|Monsieur|Madame|Mme)\b\.?"
_ROLE = r"(?:agent|advisor|adviser|rep|representative|operator|csr|support\s+agent|customer|caller|client|user|member)"
# (a part of the cue in lower case, the pattern) with the name as group n.
_PATTERNS = [(w, re.compile(p, re.I)) for w, p in (
    *((w, rf"\b{w.replace(' ', chr(92) + 's+')}\s+(?:{_TITLE}\s+)?(?P<n>{_FULL})") for w in (
        "my name is", "the name is", "me llamo", "mi nombre es", "je m'appelle", "je m’appelle", "mon nom est", "ich heiße", "mein name ist", "should be under", "handover by")),
    ("cust", rf"(?:^|[\s;/.])cust\s+(?P<n>{_FULL})(?=\s+called)"),
    *((w, rf"(?<![\w]){w}\b\.?\s+(?P<n>{_LOWER_NAME})") for w in ("mr", "mrs", "ms", "miss", "dr", "herr", "frau", "señora", "señor", "sr", "sra", "monsieur", "madame", "mme")),
    ("people under", rf"\btwo\s+people\s+under\s+(?P<n>{_LISTED})"),
    ("speaking", rf"\bgood\s+(?:morning|afternoon|evening),\s+(?P<n>{_FULL})\s+speaking\b"),
    ("this is", rf"\bthis\s+is\s+(?P<n>{_FULL})\s+from\b"),
    ("it is", rf"\bit\s+is\s+(?P<n>{_FULL})\s*,?(?=\s+and\s+the\s+number)"),
    *((w, rf"\b{w.replace(' ', chr(92) + 's+')}\s+(?P<n>{_FULL})\s*,?\s+(?=(?:(?:and|y|et|und)\s+)?(?:my|mi|mon|meine?)\s+(?:e?-?mail|number|phone|address|id|nummer|teléfono|correo|número|numéro|adresse)\b)") for w in ("i am", "soy", "je suis", "ich bin")),
    ("disputes", rf"\bcaller\s+(?P<n>{_LISTED})\s+disputes\b"),
    ("wants the", rf"(?P<n>{_FULL})\s+wants\s+the\s+[a-z ]+\s+to\s+ring\s+back\b"),
    (" (", rf"(?:^|[\n|]|\s{{2,}}|[\])>\d]\s)\s*(?:\*\*|\[)?(?P<n>{_LOWER_NAME}(?:\s{_LOWER_NAME})?)\s\({_ROLE}\)(?=\]|\*\*|\s*[:>-]|\s-)"),
)]
# Sounds and fillers within a sentence; they are blanked before cues are looked for.
_NOISE = re.compile(
    rf"\(\([^()\n]*\)\)|\[(?!\s*(?:at|dot)\s*\]|{_ROLE}\]|[^\]\n]*\({_ROLE})[^\[\]\n\d]*\]|\[silence[^\]\n]*\]|\((?!\s*(?:at|dot)\s*\)|{_ROLE}\))[^()\n\d]+\)|<[^<>\n\d]+>|\{{(?!at\}}|dot\}})[^{{}}\n]*\}}|(?<![\w*])\*[^*\n]+\*(?![\w*])|♪[^♪\n]*♪?"
    r"|,\s(?:um|uh|er|erm|ah|hmm|hm|mm|you know|i mean)(?=,)|(?<=\s)(?:um|uh|er|erm|ah|hmm|hm|mm|you know|i mean),", re.I)
#: Words that are no name after a cue.
_NOT_NAMES = frozenset("the a an my your not and or from on in at by to here there under sorry calling called already re regarding about out back still also i y et und que".split())
_SCORE = {"email": 5, "national_id": 3, "phone": 3, "address": 4, "person": 2}


def spelled_digits(s: str) -> int:
    return len(re.findall(_DIGIT, s, re.I))


_STREET_WORD = re.compile(r"\bst\b|street|stra(?:ß|ss)e|str\.|court|\bct\b|\bave|terrace|close|lane|\bln\b|\brow\b|road|\brd\b|drive|\bdr\b|blvd|boulevard|\bway\b|place|square|crescent|gardens|grove|rue|chemin|allée|impasse|quai|calle|plaza|paseo|camino|carrera|ronda|weg|gasse|platz|ring|ufer|damm", re.I)


_CUES = [(cue if " (" in cue else cue.split()[-1], p) for cue, p in _PATTERNS]
_HAS_DIGIT = re.compile(r"\d")
_HAS_NUMBER = re.compile(r"zero|five|three|seven|cero|cinco|siete|null|sieben|zwei|zéro|cinq|sept")
_HAS_NOISE = re.compile(r"[(\[<{*♪]|,\s(?:u|e|a|h|m|y|i)|(?:um|uh|er|erm|ah|hmm|hm|mm|know|mean),", re.I)


def label_spans(text: str, names: bool = True, numbers: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, entity) of the certain mentions, without overlaps, in order.

    names: emails and persons; numbers: phones, identity numbers and addresses.
    """
    found: list[tuple[int, int, str]] = []
    s = _NOISE.sub(lambda m: " " * len(m[0]), text) if _HAS_NOISE.search(text) else text
    low = s.lower()
    if len(low) != len(s):  # some letter changes its length
        low = s
    if names:
        if "@" in s:
            found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(s)]
        if "dot" in low or "punto" in low or "point" in low or "punkt" in low or "at)" in low or "at]" in low or "at}" in low:
            found += [(m.start(), m.end(), "email") for m in _EMAIL_SPELLED.finditer(s)]
        for cue, p in _CUES:
            if cue in low:
                for m in p.finditer(s):
                    a, e = m.span("n")
                    words = s[a:e].split()
                    while words and not words[-1].endswith(".") and words[-1].strip(",").casefold() in _NOT_NAMES:
                        e = a + s[a:e].rstrip().rfind(words[-1])
                        words.pop()
                    if words and (words[0].endswith(".") or words[0].strip(",").casefold() not in _NOT_NAMES):
                        found.append((a, a + len(s[a:e].rstrip()), "person"))
    if numbers:
        if _HAS_NUMBER.search(low):
            found += [(m.start(), m.end(), "national_id" if spelled_digits(m[0]) == 9 else "phone") for m in _SPELLED.finditer(s)]
        if _HAS_DIGIT.search(s):
            found += [(m.start(), m.end(), "phone") for m in _PHONES.finditer(s) if sum(c.isdigit() for c in m[0]) >= 9]
            found += [(m.start(), m.end(), "national_id") for m in _IDS.finditer(s)]
            if _STREET_WORD.search(low):
                found += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(s)]
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (-_SCORE[x[2]], x[0] - x[1], x[0]))
    kept: list[tuple[int, int, str]] = []
    for f in found:
        if all(f[1] <= k[0] or k[1] <= f[0] for k in kept):
            kept.append(f)
    return sorted(kept)
