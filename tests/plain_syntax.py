"""The syntax rules in plain Python, on match objects and slices: what the column expressions are held against.

Only the fixed values (cue patterns and word lists) are shared with the library.
"""

import regex

from lexgrain.functions import patterns as P
from lexgrain.functions.text import S
from lexgrain.functions.words import FILLERS, FINITE

SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
HIDDEN = "\x00"


def cue(java):
    """A pattern of the library in Python's dialect."""
    return regex.compile(java.replace(S, f"[{SPACE}]").replace(r"[\s\S]", "(?s:.)").replace(r"\s", " \t\n\x0b\f\r").replace(r"\d", "[0-9]").replace(r"\z", r"\Z"))


CUES = {name: cue(getattr(P, name)) for name in dir(P) if name.isupper() and len(name) > 2 and isinstance(getattr(P, name), str)}
HANGING = regex.compile(rf"(?i)[,;]?[{SPACE}]+(?:wenn|soweit|sofern|falls|und|oder|sowie|dass)\Z")


def has(name, text):
    return CUES[name].search(text) is not None


def words(text):
    return regex.split(f"[{SPACE}]+", text)


def letters(word):
    return "".join(x for x in word.lower() if "a" <= x <= "z" or x in "äöüß")


def strip(text):
    return text.strip(SPACE)


def without_last(text, marks):
    return text[:-1] if text[-1:] and text[-1] in marks else text


def tidy(text):
    text = regex.sub(f"[{SPACE}]+", " ", text)
    text = regex.sub(r" ([,;.])", r"\1", regex.sub(r",(?: ?,)+", ",", text)).strip()
    if text[:1] and text[0] in ",;:":
        text = text[1:].lstrip()
    return HANGING.sub("", without_last(text, ".,;:")).strip()


def telling(text):
    if len(text) < 4 or len(text.split(" ")) == 1 and text.lower() in FINITE:
        return False
    return any(w not in FINITE and w not in FILLERS for w in regex.findall("[a-zäöüß]{4,}", text.lower()))


def numbers_whole(text):
    return regex.sub("([0-9]),([0-9])", "\\1\x01\\2", text)


def mask(text):
    """Parentheses and subordinate clauses as NULs, each with the comma that ends it."""
    text = regex.sub(r"\([^()]*\)", lambda m: HIDDEN * len(m[0]), numbers_whole(text))
    hidden, commas = set(), [i for i, x in enumerate(text) if x == ","]
    for i, end in zip(commas, commas[1:] + [len(text) - 1]):
        rest = text[i + 1 :].lstrip(SPACE)
        if has("SUBJUNCTION", words(rest)[0]) or has("RELATIVE", rest):
            hidden.update(range(i, end + 1))
    return "".join(HIDDEN if i in hidden else x for i, x in enumerate(text))


def role(front):
    front = strip(front)
    if not front or has("PREDICATIVE", front):
        return "rf" if front else None
    if has("CONDITIONAL_FRONT", front):
        return "tb"
    if has("PRONOUN", front) or has("BARE_SUBJECT", front):
        return None
    return "rf" if regex.match("[A-ZÄÖÜ]", front) and len(words(front)) <= 3 else "tb"


class Sentence:
    def __init__(self, text, title=""):
        self.text, self.title = text, title or ""
        masked = mask(text)
        self.verb = CUES["FINITE_VERB"].search(masked)
        self.comma = masked.find(",")
        self.first = letters(words(strip(text))[0]) in FINITE
        self.front = strip(text[: self.verb.start()]) if self.verb else ""
        self.typ = self.type()

    def type(self):
        t = self.text
        if has("APPLICATION_TITLE", self.title) or has("APPLICATION", t):
            return "anwendung"
        for name, typ in (("CALCULATION", "rechenregel"), ("EQUATION", "gleichstellung"), ("FICTION", "fiktion")):
            if has(name, t):
                return typ
        if has("TARIFF", t) and regex.search("[0-9]", t):
            return "tarif"
        if has("REFERENCE", t) and not regex.search(r"(?i)(?<![A-Za-z0-9_])(?:wenn|soweit)(?![A-Za-z0-9_])", t):
            return "verweisung"
        if has("DEFINITION_STRONG", t) or has("DEFINITION_SHAPE", t) and not has("SUBJUNCTION", t[:24]):
            return "definition"
        conditional = self.first or has("SUBJUNCTION", t) or self.verb and (has("CONDITIONAL_FRONT", self.front) or has("PREDICATIVE", self.front))
        return "konditional" if conditional else "aussage"

    def exception(self):
        """The clause around the cue: from the mark before it to the mark behind it, the verb, or the end."""
        found = CUES["EXCEPTION"].search(self.text)
        if not found:
            return None
        flat, at = numbers_whole(self.text), found.start()
        marks = [i for i, x in enumerate(flat[: at + 1]) if x in ",;"]
        ends = [flat.find(x, at) for x in ",;"]
        end = min([e for e in ends if e > found.end()] + [len(self.text)])
        if self.verb and at < self.verb.start() < end:
            end = self.verb.start()
        piece = strip(without_last(self.text[marks[-1] + 1 if marks else at : end], ".,;"))
        return piece if len(piece) >= 6 and len(words(piece)) <= 28 else None

    def condition(self):
        """(from, to, text, introducer)."""
        found = CUES["CONDITION"].search(self.text)
        if not found:
            return None
        start = found.end(1)
        if start == 0:
            end = self.comma if self.comma > 8 else len(self.text)
        else:
            end = next((k for k, x in enumerate(self.text) if x == "," and k - start > 8 and letters(words(strip(self.text[max(start, k - 40) : k]))[-1]) in FINITE), None)
            if end is None:
                end = self.text.find(";", start)
                end = len(self.text) if end < 0 else end
        piece = strip(without_last(self.text[start:end], ".;"))
        return (start, end, piece, found[2].lower()) if len(piece) >= 8 else None

    def elements(self):
        """The name of the branch, and its candidates as (kind, reason, pieces)."""
        t, verb = self.text, self.verb
        exception = self.exception()
        out = [("ausn", "Ausnahmesignal im Satz", [exception])] if exception else []
        if self.first and self.comma > 0:
            return "v1-bedingung", out + [("tb", "Verberststellung: uneingeleiteter Bedingungssatz", [t[: self.comma]]), ("rf", "Nachfolgender Hauptsatz", [t[self.comma + 1 :]])]
        shape = CUES["DEFINITION_SHAPE"].search(t)
        if self.typ == "definition" and shape:
            return "definiendum", out + [("def", "Definiendum vor dem Kopulaverb", [shape[1]]), ("tb", "Definiens — Merkmale des Begriffs", [shape[3]])]
        if self.typ == "gleichstellung" and verb:
            closing = bracket(t, verb.start())
            order = [t[: verb.end()]] + ([closing[2]] if closing else [])
            return "gleichstellung", out + [("tb", "Gleichgestellter Gegenstand", [t[verb.end() : closing[0] if closing else None]]), ("rf", "Gleichstellungsanordnung", order)]
        if self.typ in ("tarif", "rechenregel") and not has("SUBJUNCTION", t) and not self.first:
            case = [("tb", "Anwendungsfall vor dem Tarifprädikat", [self.front])] if role(self.front) == "tb" else []
            return "tarifsatz", out + case + [("rf", {"tarif": "Tarif", "rechenregel": "Rechenregel"}[self.typ] + " — vollständig Rechtsfolge", [t[verb.start() if verb else 0 :]])]
        left, colon, right = (strip(x) for x in t.partition(":"))
        if colon and 8 <= t.index(":") <= len(t) - 8 and has("COLON_CUE", left) and len(words(right)) >= 3:
            return "doppelpunkt", out + [("tb", "Bedingungsteil vor dem Doppelpunkt", [left]), ("rf", "Anordnungsteil nach dem Doppelpunkt", [right])]
        condition = self.condition()
        if condition:
            return "konditionalsatz", out + list(self.around(*condition))
        if not verb:
            return None, out + [("rf" if self.typ in ("tarif", "rechenregel") else "tb", "Kein finites Verb erkannt — Satz unzerlegt", [t])]
        rest, kind = strip(t[verb.start() :]), role(self.front)
        if kind == "rf":
            return "rf", out + [("rf", "Prädikativ im Vorfeld → Rechtsfolge vorangestellt", [self.front]), *consequence_first(rest)]
        closing = bracket(t, verb.start())
        if kind == "tb":
            out.append(("tb", "Konditionales Adverbial im Vorfeld → Anwendungsfall", [self.front]))
        plain = "Hauptsatzprädikat → Rechtsfolge" if kind == "tb" else "Vorfeld ist Normgegenstand, kein Tatbestandsmerkmal"
        return kind, out + [("rf", "Hauptsatzprädikat", [t[verb.start() : closing[0]], closing[2]]) if closing else ("rf", plain, [rest])]

    def around(self, start, end, piece, introducer):
        """What stands around the condition: the front field and the main clause in one or two pieces."""
        yield "tb", f'Konditionalsatz mit „{introducer}"', [piece]
        bare = self.text[:start] + HIDDEN * (end - start) + self.text[end:]
        verb = CUES["FINITE_VERB"].search(mask(bare))
        if not verb:
            return
        front = tidy(self.text[: verb.start()])
        closing = bracket(bare, verb.start())
        until = closing[1] if closing else len(self.text)
        cut = verb.start() < start < until
        pieces = [self.text[verb.start() : start], self.text[end:until]] if cut else [self.text[verb.start() : until]]
        if role(front) == "rf":
            yield "rf", "Prädikativ im Vorfeld", [front]
            yield "tb", "Nachfeld trägt die Voraussetzungen", pieces
        elif role(front) == "tb":
            yield "tb", "Konditionales Adverbial im Vorfeld", [front]
            yield "rf", "Hauptsatzprädikat", pieces
        else:
            yield "rf", "Hauptsatzprädikat (Vorfeld ist Normgegenstand)", pieces

    def analysis(self):
        """(typ, front field, [(kind, text, parts, reason)])."""
        if self.typ == "anwendung":
            return self.typ, None, []
        branch, candidates = self.elements()
        kept = []
        for kind, reason, pieces in candidates:
            parts = [p for p in map(tidy, pieces) if telling(p)]
            if parts and not any(text == parts[0] and (len(parts) == 1 or k == kind) for k, text, *_ in kept):
                kept.append((kind, parts[0], parts if len(parts) > 1 else None, reason + " (mehrteilig)" * (len(parts) > 1)))
        return self.typ, branch, kept


def bracket(text, verb):
    """(from, to, text) of the participle or infinitive that closes what the verb opens."""
    text = regex.sub(rf"[.;][{SPACE}]*\Z", "", text)
    end = len(mask(text).rstrip(HIDDEN + SPACE + ",;"))
    if not has("BRACKET_OPEN", text[verb : verb + 40]) or end <= verb + 3:
        return None
    found = CUES["BRACKET_CLOSE"].search(text[:end])
    if not found or found.start(1) <= verb + 3:
        return None
    piece = strip(text[found.start(1) : end])
    return (found.start(1), end, piece) if piece and len(words(piece)) <= 4 else None


def consequence_first(rest):
    clause = CUES["SUBCLAUSE"].search(rest)
    if clause:
        at = clause.start() + 1
        return [("rf", "Rest des Hauptsatzes", [rest[:at]]), ("tb", "Nebensatz trägt die Voraussetzungen", [rest[at:]])]
    head, *tail = words(rest)
    return [("tb", "Nachfeld trägt die Voraussetzungen", [" ".join(tail) if tail and head.lower() in FINITE else rest])]
