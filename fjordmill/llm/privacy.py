"""Personal information in free text: found, typed and replaced by placeholders.

Spans are proposed by type (email, phone, identity, address, name) and judged by labelers that vote for, against or
not at all: patterns, a gazetteer of given and family names, a word model learnt from that gazetteer (endings of given
and of family names against other capitalised words), and labelers of the context to the left and to the right. The
labelers' reliabilities are estimated by expectation-maximisation (each labeler has a distribution over its votes given
the hidden truth), and a logistic span classifier is trained on the resulting probabilities. The classifier then decides
every proposed span of every document.

All models are trained on all documents and all names, in three steps that each leave counts behind: words by the number
of texts they stand in; spans by votes and surroundings; the votes alone. What a model doesn't see of a word or span is
no part of the counts, so training on them is the same as training on every word and span. Counts of endings and of vote
patterns (five types of 3^8 at most) go to the driver; those of surroundings, which grow with the texts, stay on the
executors, where the gradients of the span classifier are summed.

Bounds: whether a word is in the gazetteer is looked up in a bit table of at most ``MOST_BITS`` bits that the executors
fill, so the gazetteer may have any length and is never collected; where it outgrows the table, some words count as
listed that are not, which is a vote and no decision. Labelers of the context look at the ``CONTEXT`` characters on either
side of a span. None of this bounds what is searched: a span may be of any length, and so may a text.

A name is a full name as written, without title, or a given name standing alone in a greeting. An address runs from its
first to its last part, with postcode and place if these follow. Overlapping spans: the earlier and longer one stays.

Edge cases: null texts give no spans and stay null; empty texts stay empty; repeated texts each give their rows; equal
passages of one text are one row in found() and each replaced; texts and spans may be of any length; with an empty gazetteer the
word model and gazetteer don't vote; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.session import Workspace, side_by_side

#: Bits of the largest table of the gazetteer (16 MiB).
MOST_BITS = 1 << 27
CONTEXT = 60
#: Hashed weights of a span's surroundings and shape in the span classifier.
SURROUNDINGS = 1 << 12
TYPES = ("email", "phone", "identity", "address", "name")
VOTES = 8
BINS = 1 << 14
#: The span classifier's weights: those of the votes, then those of the surroundings, then the intercept.
VOTE_WEIGHTS = len(TYPES) * VOTES * 3
WEIGHTS = VOTE_WEIGHTS + SURROUNDINGS + 1
#: Pieces of a span's surroundings, 12 bits each.
PIECES = 4
#: What is known before any text is weighed for this number of texts.
KNOWN = 3000
#: Groups of equal spans in a block of the classifier's training table.
BLOCK = 1 << 17

W = r"[^\W\d_a-zà-öø-ÿß][^\W\d_]+"  # a word of letters that begins with a capital
B = "[  ]"
GAP = rf"(?:{B}|&nbsp;)"

AT = re.compile(rf"@|{B}?[\[({{]{B}?(?:at|@){B}?[\])}}]{B}?", re.I)
_DOT = rf"(?:\.|{B}?[\[({{]{B}?(?:dot|\.){B}?[\])}}]{B}?|{B}dot{B})"
DOMAIN = re.compile(rf"[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,}}", re.I)
#: After an " at " in words the last dot must be one in words too.
SPOKEN = re.compile(rf"[^\W_][\w-]*(?:(?:{B}dot{B}|\.)[^\W_][\w-]*)*{B}dot{B}[^\W\d_]{{2,}}", re.I)
NUMBER = re.compile(r"(?<![\w.+,-])(?:\+\d|\(\d|\d)[\d ().\-/ ]{6,22}\d(?:-[A-Z])?(?![\w]|[-.]\d)")
#: Forms of phone numbers (groups of digits) and of identity numbers.
PHONE_FORMS = re.compile(r"\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d{1,5}(?:[ .-]\d{2,6}){0,5}|\(\d{2,5}\) ?\d{3,4}[ -]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?: \d\d){4}|0\d{1,4}[ /-]\d{5,8}|0\d{2,4}[ /-]\d{3,6}[ -]\d{2,4}")
IDENTITY_FORMS = re.compile(r"\d{11}|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}[- ]\d{5}|\d{7,8}-?[A-Z]")
PHONE_CUES = ("phone", "call", "tel", "tel.", "ring", "reach", "mobile", "fax", "telefon", "teléfono", "téléphone", "dial", "or", "|", "at", "on")
IDENTITY_CUES = ("identity", "lists", "holder", "fødselsnummer", "ausweisnummer", "documento", "d'identité", "passport", "badge", "personnummer", "ssn", "id")
NUMBER_AGAINST = ("job", "used", "cores", "ratio", "accession", "catalogue", "coordinates", "hash", "build", "ec", "run", "table", "queue", "seeds", "samples", "version", "sheet")

STREETS = ("Street", "St.", "Lane", "Road", "Rd.", "Close", "Ave.", "Avenue", "Drive", "Court", "Way", "Square", "Boulevard", "Blvd.", "Terrace", "Place", "Crescent")
SUFFIXES = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "bakken", "veien", "vegen", "gata", "gaten", "gate", "vei")
WAYS = ("Weg", "Straße", "Strasse", "Allee", "Platz", "Gasse", "Ring", "Damm", "Ufer", "Vei", "Gate")
LEADS = ("rue", "avenue", "boulevard", "chemin", "impasse", "allée", "quai")
PLAZAS = ("C/", "Calle", "Avda.", "Avenida", "Plaza", "Paseo", "Via")
_PLACE = rf"(?:(?:,[ ]?|[ ]?\n){W}(?:[ -]{W})?[ ]\d{{4,5}}\b|(?:,[ ]?|[ ]?\n)\d{{4,5}}[ ]{W}(?:[ -]{W})?|,[ ]{W}(?=[,.;)\n]|$)|\n{W}(?=\n|$))?"
ADDRESS = re.compile(
    rf"(?:Flat[ ]\d+[A-Za-z]?,[ ])?\b\d{{1,4}}[A-Za-z]?[ ](?:{W}[ ]){{1,2}}(?:{'|'.join(map(re.escape, STREETS))})(?!\w)(?:,[ ](?:Apt|Flat|Suite|Unit|Apt\.)[ ]\d+[A-Za-z]?)?{_PLACE}"
    rf"|\b(?:(?:Am|An[ ]der|Im|In[ ]der|Zum|Zur|Auf[ ]der)[ ])?[^\W\d_a-zà-öø-ÿß][^\W\d_]*?(?:{'|'.join(map(re.escape, SUFFIXES))})[ ]\d{{1,4}}[A-Za-z]?\b{_PLACE}"
    rf"|\b{W}(?:[ -]{W})?[ ](?:{'|'.join(WAYS)})[ ]\d{{1,4}}[A-Za-z]?\b{_PLACE}"
    rf"|\b\d{{1,4}}(?:[ ](?:bis|ter))?,?[ ](?:{'|'.join(LEADS)})[ ](?:(?:de|du|des|de[ ]la)[ ]|d['’]|de[ ]l['’])?{W}(?:[ -]{W})?{_PLACE}"
    rf"|(?<!\w)(?:{'|'.join(map(re.escape, PLAZAS))})[ ](?:(?:de|del)[ ])?{W}(?:[ ]{W})?,?[ ]\d{{1,4}}(?:,[ ]\d{{1,2}}[ºª°](?:[ ][A-Z]\b)?)?{_PLACE}"
)
def _cases(word: str) -> list[str]:
    return ["".join(c) for c in product(*({x.lower(), x.upper()} for x in word))]


#: What an address or an email can't do without, and which of them it points to. Texts are searched for all of these at
#: once, and the patterns are tried where they are hit.
HINTS = {
    **{f" {w}": "address" for w in (*STREETS, *(f"{x} " for x in LEADS), *(f"{x} " for x in WAYS))},
    **{f"{w} ": "address" for w in (*SUFFIXES, *PLAZAS)},
    "@": "email", **{f"{o}{g}{at}": "email" for o in "([{" for g in ("", " ", " ") for at in _cases("at")},
    **{f"{g}{dot}{h}": "dots" for g in "  " for h in "  " for dot in _cases("dot")},
}
_KEPT: dict = {}
_HASHED: dict = {}


def hints(text: str) -> dict[str, list[int]]:
    """Where the hints of each kind end, in order."""
    out: dict[str, list[int]] = {}
    if "automaton" not in _KEPT:
        try:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for word, kind in HINTS.items():
                machine.add_word(word, (kind, word[0] not in "  @([{" and word[:-1] in SUFFIXES))
            machine.make_automaton()
        except ImportError:
            machine = None
        _KEPT["automaton"] = machine
    if (machine := _KEPT["automaton"]) is not None:
        for end, (kind, numbered) in machine.iter(text):
            if not numbered or text[end + 1 : end + 2].isdigit():
                out.setdefault(kind, []).append(end + 1)
        return out
    for word, kind in HINTS.items():
        at = text.find(word)
        while at >= 0:
            out.setdefault(kind, []).append(at + len(word))
            at = text.find(word, at + 1)
    return {k: sorted(v) for k, v in out.items()}


def _local(text: str, end: int, low: int) -> int:
    """Start of the local part of an email that ends at ``end``; ``end`` where there is none."""
    at = end
    while at > low and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
        at -= 1
    while at < end and not text[at].isalnum():
        at += 1
    return at


def _spoken_at(text: str, dot: int) -> int | None:
    """Where the blank of the " at " stands that the labels before a " dot " lead back to."""
    while True:
        label = dot
        while label and (text[label - 1].isalnum() or text[label - 1] in "_-."):
            label -= 1
        if label == dot or label < 4 or text[label - 1] not in "  ":
            return None
        if text[label - 3 : label - 1].lower() == "at" and text[label - 4] in "  ":
            return label - 4
        if text[label - 4 : label - 1].lower() != "dot" or label < 6 or text[label - 5] not in "  ":
            return None
        dot = label - 5


def emails(text: str, signs: list[int], dots: list[int]):
    """(start, end) of emails. An email is read to both sides of its sign, as far as it goes."""
    found, spots = [], []
    for e in signs:
        for at in range(max(0, e - 5), e):
            m = AT.match(text, at)
            if m and m.end() >= e:
                spots.append((m.start(), m.end(), DOMAIN))
                break
    for d in dots:
        at = _spoken_at(text, d - 5)
        if at is not None:
            spots.append((at, at + 4, SPOKEN))
    done = 0
    for at, after, domain in sorted(spots, key=lambda x: x[:2]):
        if at < done:
            continue
        start = _local(text, at, done)
        if start < at and (m := domain.match(text, after)):
            found.append((start, m.end()))
            done = m.end()
    return found


STARTS = re.compile(r"\b\w")


def _back(text: str, at: int, words: int) -> int:
    """Where the words-th word to the left begins, whatever the lengths of the words."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def addresses(text: str, ends: list[int]):
    """Matches of addresses: the pattern is tried at each word from the sixth before a hint up to the hint, and may
    end anywhere."""
    tried = 0
    for e in ends:
        low = max(tried, _back(text, e, 6))
        while low < e:
            m = STARTS.search(text, low, e)
            if m is None:
                break
            hit = ADDRESS.match(text, m.start())
            if hit:
                yield hit
            low = hit.end() if hit else m.start() + 1
        tried = max(tried, low, e)


CAPITAL = re.compile(W)
LOWER = re.compile(r"(?<![\w@.+-])[a-zà-öø-ÿß]{3,}+(?![\w@+-]|\.\w| ?[\[(])")
#: Greetings and titles.
GREETINGS = ("Dear", "Hallo", "Hello", "Hi", "Hei", "Hola", "Bonjour", "Salut", "Liebe", "Lieber", "Kjære", "Cher", "Chère", "Estimado", "Estimada", "Querido", "Querida", "Moin", "Hej")
TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Fru", "Sr", "Sra", "Mme", "Professor", "Doctor")
#: A greeting may follow a quotation or log prefix or a mark in brackets; what follows other words is judged all the same.
GREETING = re.compile(rf"(?<!\w)(?<!\w[.+-])(?:{'|'.join(GREETINGS)})[ ]({W}(?:-{W})?)(?=[,!:]?[ ]*$)", re.M)
LEFT_OF = re.compile(rf"(?:(?<![\w-])({W}(?:-{W})?){GAP})?(?:(?<![\w-])([^\W\d_a-zà-öø-ÿß])\.{GAP})*$")
INVERTED = re.compile(rf",[ ]({W}(?:-{W})?)(?:[ ][^\W\d_a-zà-öø-ÿß]\.)?(?![\w-])")
NAME_LEFT = ("by", "for", "thank", "and", "of", "to", "call", "von", "de", "from:", "to:", "cc:", "bcc:", "til:", "fra:", "an:", "von:", "para:", "à:", "a:", "de:", "i", "y", "et", "und", "og", "|", "--", "/", "with", "dear", *(t.lower() for t in TITLES), *(t.lower() + "." for t in TITLES))
NAME_AGAINST = ("the", "from", "aus", "fra", "of the", "compared", "der", "das", "die", "la", "el", "le", "species")
NAME_RIGHT = ("<", "|", "(", ":", ",", "\n", " :", ".", " (", " and ", " for ", " if ")
EPITHET = re.compile(r"[  ]?[a-z]+(?:osa|ensis|ula|inum|ata|icola|eata|ica|ella|ii)\b")
STOP = {w.lower() for w in ("The", "We", "In", "On", "At", "If", "No", "Is", "It", "For", "With", "From", "After", "Once", "See", "Run", "Table", "Call", "Please", "Chain", "Family", "Room", "Grid", "Sample", "Home", "According", "Minutes", "Questions", "Best", "Regards", "Vennlig", "Hilsen", "Info", "Warn", "Error", "Das", "Der", "Die", "Im", "Wir", "Nach", "Für", "El", "La", "Le", "Les", "Tras", "Para", "Pour", "Nous", "Après", "Den", "Vi", "Etter", "Login", *GREETINGS, *TITLES)}


def _ngrams(word: str) -> list[int]:
    """Hashed endings of a word, case ignored: short ones, so that what is learnt holds for names not in the list."""
    w = word.lower() + "$"
    return [_h("e" + w[-n:]) for n in range(3, 6) if len(w) > n]


def _h(s: str) -> int:
    """A hash that is the same in every process."""
    x = 1469598103934665603
    for ch in s.encode():
        x = ((x ^ ch) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 29)) % BINS


def _ending(word: str) -> int:
    """The hashed endings of a word as one number; the word model sees nothing else of it."""
    key = 0
    for g in _ngrams(word):
        key = key << 15 | g + 1
    return key


def _logistic(rows: list[int], y: np.ndarray, weight: np.ndarray, l2: float = 0.02, steps: int = 200, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Sparse logistic regression over endings by gradient steps with per-weight rates; the last weight is the
    intercept. Returns the weights and each ending's score."""
    w, g2 = np.zeros(BINS + 1), np.full(BINS + 1, 1e-8)
    keys = np.asarray(rows, np.int64)
    grams = np.stack([(keys >> shift & 0x7FFF) - 1 for shift in (0, 15, 30)], axis=1)
    own, at = np.nonzero(grams >= 0)[0], grams[grams >= 0]

    def scores():
        return 1 / (1 + np.exp(-(np.bincount(own, weights=w[at], minlength=len(keys)) + w[-1])))

    for _ in range(steps if len(keys) else 0):
        err = (scores() - y) * weight
        grad = np.bincount(at, weights=err[own], minlength=BINS + 1) + l2 * w * weight.sum() / 100
        grad[-1] = err.sum()
        g2 += grad**2
        w -= rate * grad / np.sqrt(g2)
    return w, scores()


def _slots(word: str, kind: str, bits: int) -> tuple[int, int]:
    """The two bits of a name in the gazetteer's table."""
    x = 1469598103934665603
    for ch in f"{kind}:{word}".encode():
        x = ((x ^ ch) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return x % bits, (x >> 33) % bits


def bit_table(names, bits: int = 1 << 16) -> np.ndarray:
    """The table of a list of (name, kind); gazetteer() makes the same of a DataFrame."""
    out = np.zeros(bits // 64, np.uint64)
    for n, k in names:
        for slot in _slots(n.lower(), k, bits):
            out[slot >> 6] |= np.uint64(1) << np.uint64(slot & 63)
    return out


class Words:
    """How much a word looks like a given or a family name; scores are kept."""

    def __init__(self, table: np.ndarray, weights: dict[str, np.ndarray] | None, common: frozenset = frozenset()):
        self.common = common
        self.met: set[str] = set()
        self.likely: set[str] = set()
        self.table, self.weights = table, weights
        self.forget()

    def forget(self) -> None:
        self.kept, self.known, self.met, self.likely = {"given": {}, "family": {}}, {"given": {}, "family": {}}, set(), set()

    def score(self, word: str, kind: str) -> float:
        kept = self.kept[kind]
        s = kept.get(word)
        if s is None:
            if len(kept) > 500_000:
                kept.clear()
            if self.weights is None or word.lower() in STOP:
                s = 0.0
            else:
                w = self.weights[kind]
                s = float(1 / (1 + np.exp(-(w[_ngrams(word)].sum() + w[-1]))))
            kept[word] = s
        return s

    def listed(self, word: str, kind: str) -> bool:
        known = self.known[kind]
        hit = known.get(word)
        if hit is None:
            if len(known) > 500_000:
                known.clear()
            bits = len(self.table) * 64
            hit = known[word] = bits > 0 and all((int(self.table[s >> 6]) >> (s & 63)) & 1 for s in _slots(word.lower(), kind, bits))
        return hit

    def may_be_family(self, found: set[str]) -> set[str]:
        new = found - self.met
        if new:
            if len(self.met) > 500_000:
                self.met, self.likely = set(), set()
            self.met |= new
            self.likely |= {w for w in new if len(w) > 2 and (self.score(w, "family") > 0.3 or self.listed(w, "family"))}
        return found & self.likely

    def ordinary(self, word: str) -> bool:
        """A word of the texts' language rather than a name, whether or not it is in the gazetteer."""
        return word.lower() in STOP or word.lower() in self.common

    def may_be_given(self, word: str) -> bool:
        parts = word.split("-")
        return word not in TITLES and any(self.listed(p, "given") for p in parts) or not any(self.ordinary(p) for p in parts)


def learn_words(endings: dict[str, dict[int, int]], table: np.ndarray, common: frozenset = frozenset()) -> Words:
    """endings: how many words of each kind (given, family, other) have which ending. Other words may hold names that
    the list lacks: those that score high after a first round are left out of the next."""
    if not endings["given"] and not endings["family"]:
        return Words(table, None, common)
    weights = {}
    for kind, rival in (("given", "family"), ("family", "given")):
        good, against, bad = (sorted(endings[k].items()) for k in (kind, rival, "other"))
        for turn in range(3):
            keys, n = [k for k, _ in good + against + bad], np.array([n for _, n in good + against + bad], float)
            y = np.arange(len(keys)) < len(good)
            weight = np.where(y, n, n * min(1.0, n[y].sum() / max(1.0, n[~y].sum())))
            weights[kind], scores = _logistic(keys, y, weight)
            # unlisted words: the mean score of listed ones tells how often a name is listed at all
            listed = np.average(scores[y], weights=n[y]) if good else 1.0
            bad = [x for x, v in zip(bad, scores[len(good) + len(against) :]) if v < listed / 3]
    return Words(table, weights, common)


def _last_word(left: str) -> str:
    parts = left.split()
    return parts[-1].lower() if parts else ""


def _sign(*conditions: tuple[bool, int]) -> int:
    for ok, vote in conditions:
        if ok:
            return vote
    return 0


def _reach(text: str, at: int, words: int = 4, width: int = 80) -> int:
    """A place to the left with more than ``words`` words up to ``at``, however long they are."""
    low = max(0, at - width)
    while low and len(text[low:at].split()) <= words:
        width *= 4
        low = max(0, at - width)
    return low


JOINED = re.compile(rf"({W})-$")
ONE_MORE = re.compile(rf"(?<![\w-])[^\W\d_a-zà-öø-ÿß]\.{GAP}$")


def _name_at(text: str, start: int, end: int, words: Words):
    """The span of the name whose family name stands at start, with its votes; None where no name form fits."""
    while end < len(text) and text[end] == "-" and (m := CAPITAL.match(text, end + 1)):
        end = m.end()
    while start > 1 and text[start - 1] == "-" and (m := JOINED.search(text[_reach(text, start, 1) : start])):
        start -= len(m[0])
    if end < len(text) and (text[end].isalnum() or text[end] in "_@"):
        return None
    if start and (text[start - 1].isalnum() or text[start - 1] in "_@.+-"):
        return None
    own = max((p for p in text[start:end].split("-")), key=lambda p: words.score(p, "family"))
    low = _reach(text, start)
    m = LEFT_OF.search(text[low:start])
    first, initial, begin = m[1], m[2], start
    given = 0.0
    listed = False
    if first and first not in TITLES and first.lower() not in STOP and words.may_be_given(first):
        given, begin, listed = max(words.score(p, "given") for p in first.split("-")), low + m.start(1), any(words.listed(p, "given") for p in first.split("-"))
        form = 0
    elif initial:
        spot = text[low:start].rfind(initial + ".")
        begin, form = low + spot, 1
        # several initials in a row belong together
        while (k := ONE_MORE.search(text[max(0, begin - 9) : begin])):
            begin -= len(k[0])
    elif (m := INVERTED.match(text, end)) and m[1].lower() not in STOP and words.may_be_given(m[1]):
        given, end, form, listed = max(words.score(p, "given") for p in m[1].split("-")), m.end(), 2, any(words.listed(p, "given") for p in m[1].split("-"))
    else:
        return None
    left = text[max(0, begin - CONTEXT) : begin]
    cue = _last_word(left)
    fam = words.score(own, "family")
    votes = (
        _sign((words.listed(own, "family"), 1)),
        _sign((fam > 0.5, 1), (fam < 0.1, -1)),
        _sign((listed, 1)),
        _sign((form == 1, 0), (given > 0.5, 1), (given < 0.02 and not listed and fam < 0.5, -1)),
        _sign((cue in NAME_LEFT or not cue or left.endswith("\n"), 1), (cue in NAME_AGAINST, -1)),
        _sign((text.startswith(NAME_RIGHT, end) or end == len(text), 1)),
        _sign((words.ordinary(own) and fam < 0.9 or text[begin:end].split()[0].lower().strip(".,") in STOP, -1)),
        _sign((EPITHET.match(text, end) is not None, -1)),
    )
    return begin, end, votes


def propose(text: str, words: Words):
    """(type, start, end, votes) of all proposed spans; the votes are those of the type's labelers."""
    out = []
    hit = hints(text)
    if "email" in hit or "dots" in hit:
        for start, end in emails(text, hit.get("email", []), hit.get("dots", [])):
            s, cue = text[start:end], _last_word(text[max(0, start - CONTEXT) : start])
            plain = "@" in s
            dots = len(re.findall(r"\.|dot", s.lower()))
            out.append(("email", start, end, (1, 1 if plain or re.search(r"[\[({ \u00a0]at[\])} \u00a0]", s.lower()) else -1, 1 if dots else -1, 1 if len(s) > 8 else 0, -1 if cue in ("tag", "package") else 0, 1 if re.search(r"[^\W\d_]{2,}$", s) else -1, 0, 0)))
    for m in NUMBER.finditer(text):
        s = m.group().strip()
        start = m.start() + (len(m.group()) - len(m.group().lstrip()))
        if s.startswith("(") and ")" not in s:
            s, start = s[1:], start + 1
        phone, identity = PHONE_FORMS.fullmatch(s) is not None, IDENTITY_FORMS.fullmatch(s) is not None
        if not phone and not identity:
            continue
        before = text[max(0, start - CONTEXT) : start]
        near = [p.strip(":.,;()").lower() for p in re.split(r"[\s]+", before)][-7:]
        last = near[-4:]
        against = any(p in NUMBER_AGAINST for p in last)
        after = text[start + len(s) : start + len(s) + 12].lower()
        for kind, form, cues, other in (("phone", phone, PHONE_CUES, IDENTITY_CUES), ("identity", identity, IDENTITY_CUES, PHONE_CUES[:-4])):
            if form:
                alone = not before or before.rstrip(" ").endswith(("\n", "|"))
                out.append((kind, start, start + len(s), (1, 1 if any(p in cues for p in near) else 0, -1 if against else 0, 1 if alone and kind == "phone" else 0, -1 if phone and identity and any(p in other for p in near) and not any(p in cues for p in near) else 0, -1 if after.startswith((" cores", " seeds", " samples", " was kept")) else 0, 1 if s[0] in "+(0" and kind == "phone" else 0, 1 if kind == "identity" and re.fullmatch(r"\d{11}|\d{8}-[A-Z]", s) else 0)))
    if "address" in hit:
        for m in addresses(text, hit["address"]):
            s = m.group()
            cue = _last_word(text[max(0, m.start() - CONTEXT) : m.start()])
            out.append(("address", m.start(), m.end(), (1, 1 if re.search(r"\d", s) else -1, 1 if re.search(r"\d{4,5}", s) else 0, 1 if m.start() == 0 or text[m.start() - 1] == "\n" or cue.endswith((",", "to", "an", "til", "a", "vers", "va")) else 0, -1 if cue in ("table", "queue", "chain", "sample") else 0, 1, 0, 0)))
    if words.weights is not None:
        anchors = words.may_be_family(set(CAPITAL.findall(text)))
        if anchors:
            for m in CAPITAL.finditer(text):
                if m.group() in anchors and (n := _name_at(text, m.start(), m.end(), words)):
                    out.append(("name", *n))
        for m in GREETING.finditer(text) if any(g in text for g in GREETINGS) else ():
            g = m[1].split("-")[0]
            s = words.score(g, "given")
            if m[1].lower() not in STOP:
                out.append(("name", m.start(1), m.end(1), (1 if words.listed(g, "given") else 0, 0, 1 if words.listed(g, "given") else 0, 1 if s > 0.5 else -1 if s < 0.1 else 0, 1, 1, 0, 0)))
    return out


def surroundings(text: str, start: int, end: int) -> list[str]:
    """What a span looks like and what stands beside it: words left and right and the span's shape."""
    left, right = text[max(0, start - CONTEXT) : start].lower().split(), text[end : end + CONTEXT].lower().split()
    shape = re.sub(r"\d+", "9", text[start : start + CONTEXT])
    shape = re.sub(r"[^\W\d_a-zà-öø-ÿß]+", "A", shape)
    shape = re.sub(r"[^\W\d_A]+", "a", shape)
    return ["l" + (left[-1] if left else ""), "k" + " ".join(left[-2:]), "r" + (right[0] if right else ""), "s" + shape]


def features(kind: int, votes, around: list[str] = ()) -> list[int]:
    """Indices of the span classifier's weights: every vote of every labeler of every type has its own, and each
    piece of the surroundings one by its hash and type."""
    own = [kind * VOTES * 3 + 3 * i + v + 1 for i, v in enumerate(votes)]
    base = VOTE_WEIGHTS
    for a in around:
        k = _HASHED.get((kind, a))
        if k is None:
            if len(_HASHED) > 300_000:
                _HASHED.clear()
            k = _HASHED[(kind, a)] = base + _h(f"{kind}{a}") % SURROUNDINGS
        own.append(k)
    return own


def reliabilities(votes: np.ndarray, rounds: int = 25, trust: float = 8.0, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (n, VOTES) votes of -1, 0, 1, each as often as ``counts`` says. Returns the
    probability that each span is true and the table (2, VOTES, 3) of vote probabilities given the truth. Labelers are
    trusted to be better than chance: as many made-up agreeing votes as ``trust``."""
    if not len(votes):
        return np.zeros(0), np.full((2, VOTES, 3), 1 / 3)
    counts = np.ones(len(votes)) if counts is None else counts
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior = np.array([[trust, trust, trust / 8], [trust / 8, trust, trust]])
    for _ in range(rounds):
        table = np.stack([np.einsum("n,nlv->lv", w * counts, hot) + prior[k] for k, w in enumerate((1 - p, p))])
        table /= table.sum(axis=2, keepdims=True)
        base = np.clip(np.average(p, weights=counts), 0.05, 0.95)
        log = np.einsum("nlv,klv->nk", hot, np.log(table)) + np.log([1 - base, base])
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return p, table


class Model:
    def __init__(self, words: Words, weights: np.ndarray, tables: dict[str, np.ndarray]):
        self.words, self.weights, self.tables = words, weights, tables
        self.listed_weights = weights.tolist()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in order, without overlaps."""
        kept, w = [], self.listed_weights
        for kind, start, end, votes in propose(text, self.words):
            if sum(map(w.__getitem__, features(TYPES.index(kind), votes, surroundings(text, start, end)))) + w[-1] > 0:
                kept.append((start, -end, kind))
        kept.sort()
        out, reach = [], 0
        for start, end, kind in kept:
            if start >= reach:
                out.append((start, -end, kind))
                reach = -end
        return out


#: What the labelers can say about each type is known before any text: one made-up span of each kind of agreement.
AGREED = [(k, v) for k in range(len(TYPES)) for v in ((1,) * 6 + (0, 0), (-1,) * 6 + (-1, -1))]


def _pattern(kind: int, votes) -> int:
    """Type and votes of a span as one number."""
    for v in votes:
        kind = 3 * kind + v + 1
    return kind


def _votes_of(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The types and (n, VOTES) votes of patterns."""
    votes = np.empty((len(patterns), VOTES), np.int64)
    for i in reversed(range(VOTES)):
        patterns, votes[:, i] = np.divmod(patterns, 3)
    return patterns, votes - 1


def _count_words(texts) -> tuple[Counter, Counter]:
    """In how many texts each capitalised and each small word stands."""
    seen, small = Counter(), Counter()
    for t in texts:
        seen.update(set(CAPITAL.findall(t)))
        small.update(set(LOWER.findall(t)))
    return seen, small


def _often(texts: int) -> tuple[float, float]:
    """Capitalised and small words in more texts than this are common ones. Both are shares of all texts, so that a
    name that is misspelt here and there doesn't become common where there are many texts."""
    return max(5, texts / 150), max(1, texts / KNOWN)


def _weight(texts: int) -> float:
    """The weight of what is known before any text: as much as in ``KNOWN`` texts, in more a share. A fixed weight would
    count for nothing in many texts, and expectation-maximisation be free to part true spans from true ones."""
    return max(1.0, texts / KNOWN)


def _count_spans(texts, words: Words) -> Counter:
    """How many proposed spans have which pattern and surroundings: the pattern above 48 bits of surroundings."""
    out = Counter()
    for t in texts:
        for name, start, end, votes in propose(t, words):
            kind = TYPES.index(name)
            key = _pattern(kind, votes)
            for at in features(kind, votes, surroundings(t, start, end))[VOTES:]:
                key = key << 12 | at - VOTE_WEIGHTS
            out[key] += 1
    return out


def _judge(patterns: dict[int, int], known: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The probability that spans of each pattern are true, by pattern, and the labelers' reliabilities by type."""
    told = Counter(patterns)
    told.update({_pattern(*a): known for a in AGREED})
    keys = np.array(sorted(told), np.int64)
    counts, (kinds, votes) = np.array([told[k] for k in keys.tolist()], float), _votes_of(keys)
    truth, tables = np.zeros(len(TYPES) * 3**VOTES), {}
    for k, name in enumerate(TYPES):
        truth[keys[kinds == k]], tables[name] = reliabilities(votes[kinds == k], trust=8.0 * known, counts=counts[kinds == k])
    return truth, tables


def _block(patterns: np.ndarray, around: np.ndarray, counts: np.ndarray, truth: np.ndarray):
    """Training rows of groups of equal spans: indices of weights, truth and number."""
    kinds, votes = _votes_of(patterns)
    at = np.empty((len(patterns), VOTES + PIECES), np.int16)
    at[:, :VOTES] = kinds[:, None] * VOTES * 3 + 3 * np.arange(VOTES) + votes + 1
    for j in range(PIECES):
        at[:, VOTES + j] = VOTE_WEIGHTS + (around >> 12 * j & (1 << 12) - 1)
    return at, truth[patterns], counts.astype(float)


def _slope(w: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic loss and, after it, its gradient."""
    z = w[at].sum(axis=1) + w[-1]
    err = (1 / (1 + np.exp(-z)) - y) * weight
    grad = np.bincount(at.ravel(), weights=np.repeat(err, at.shape[1]), minlength=WEIGHTS)
    grad[-1] = err.sum()
    return np.concatenate([[((np.logaddexp(0, z) - y * z) * weight).sum()], grad])


def _descend(slope, rounds: int = 100, memory: int = 10, flat: float = 1e-6) -> np.ndarray:
    """The lowest point of a convex function by limited-memory BFGS; slope(w) gives its value and, after it, its gradient."""
    w, steps = np.zeros(WEIGHTS), []
    f, g = (out := slope(w))[0], out[1:]
    for _ in range(rounds):
        if np.abs(g).max() < flat:
            break
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            kept.append((s @ d) / (s @ y))
            d -= kept[-1] * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / np.linalg.norm(g)
        for s, y in steps:
            d += (kept.pop() - (y @ d) / (s @ y)) * s
        length = 1.0
        while True:
            out = slope(w - length * d)
            if out[0] <= f - 1e-4 * length * (g @ d):
                break
            length /= 2
            if length < 1e-6:
                return w
        if -length * d @ (out[1:] - g) > 1e-12:
            steps = [*steps[-memory + 1 :], (-length * d, out[1:] - g)]
        w, f, g = w - length * d, out[0], out[1:]
    return w


def _classifier(slopes, truth: np.ndarray, spans: int, known: float) -> np.ndarray:
    """Weights of the span classifier; slopes(w) is the sum of _slope() over all spans. Weights of surroundings are held
    back a hundred times as much as those of votes."""
    made = np.array([features(*a) for a in AGREED]), truth[[_pattern(*a) for a in AGREED]], np.full(len(AGREED), known)
    l2 = np.repeat([1e-7, 1e-5, 0.0], [VOTE_WEIGHTS, SURROUNDINGS, 1])

    def slope(w):
        out = (slopes(w) + _slope(w, *made)) / (spans + known * len(AGREED))
        out[0] += (l2 * w * w).sum() / 2
        out[1:] += l2 * w
        return out

    return _descend(slope)


def train(texts: list[str], names: list[tuple[str, str]], table: np.ndarray | None = None) -> Model:
    """A model from texts and names (text, kind) on this machine; no labels are needed. fit() does the same for tables."""
    table = bit_table(names) if table is None else table
    told, (seen, small), least = Words(table, None), _count_words(texts), _often(len(texts))
    common = {w.lower() for counts, low in zip((seen, small), least) for w, n in counts.items() if n > low}
    endings = {kind: Counter(map(_ending, {n.lower() for n, k in names if n and k == kind})) for kind in ("given", "family")}
    endings["other"] = Counter(_ending(w) for w in seen if not told.listed(w, "given") and not told.listed(w, "family"))
    words = learn_words(endings, table, frozenset(common))
    spans, patterns = _count_spans(texts, words), Counter()
    for key, n in spans.items():
        patterns[key >> 48] += n
    known = _weight(len(texts))
    truth, tables = _judge(patterns, known)
    keys = np.array(sorted(spans), np.uint64)
    rows = _block((keys >> np.uint64(48)).astype(np.int64), (keys & np.uint64((1 << 48) - 1)).astype(np.int64), np.array([spans[k] for k in keys.tolist()]), truth)
    return Model(words, _classifier(lambda w: _slope(w, *rows), truth, sum(spans.values()), known), tables)


def _slotter(bits: int):
    def run(batches):
        for b in batches:
            slots = [s for n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in _slots(n.strip().lower(), k, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], names=["slot"])

    return run


def gazetteer(names: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """The bit table of all names: 32 bits a name up to ``most``, combined on the executors."""
    told = names.select(F.col("name_text").cast("string"), F.col("name_kind").cast("string")).where("name_text is not null and name_kind is not null")
    bits = 1 << 16
    n = told.count()
    while bits < min(most, 32 * n):
        bits *= 2
    packed = told.mapInArrow(_slotter(bits), "slot long").groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    return out.view(np.uint64)


def _word_counter(batches):
    """Words with the number of texts they stand in; the row without a word has the number of texts."""
    for b in batches:
        seen, small = _count_words(b.column(0).to_pylist())
        rows = [[*seen, *small, None], [True] * len(seen) + [False] * len(small) + [None], [*seen.values(), *small.values(), b.num_rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.bool_(), pa.int64()))], names=["word", "capital", "n"])


def _name_endings(batches):
    for b in batches:
        names = [n.strip().lower() for n in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(names), b.column(1), pa.array([_ending(n) for n in names], pa.int64())], names=["name", "kind", "ending"])


def _other_endings(sent):
    def run(batches):
        told = Words(sent.value, None)
        for b in batches:
            own = [_ending(w) for w in b.column(0).to_pylist() if not told.listed(w, "given") and not told.listed(w, "family")]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], names=["ending"])

    return run


def _span_counter(sent):
    def run(batches):
        words = pickle.loads(sent.value)
        for b in batches:
            spans = _count_spans(b.column(0).to_pylist(), words)
            rows = [k >> 48 for k in spans], [k & (1 << 48) - 1 for k in spans], list(spans.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.int64()))], names=["pattern", "around", "n"])

    return run


def _packer(batches):
    """The rows of a partition as blocks of bytes, whatever the batches' size."""
    held = []
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
        if sum(h.shape[1] for h in held) >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array([np.hstack(held).tobytes()], pa.binary())], names=["block"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([np.hstack(held).tobytes()], pa.binary())], names=["block"])


def _trained(spans: DataFrame, truth: np.ndarray, groups: int, total: int, known: float) -> np.ndarray:
    """The span classifier over a table (pattern, around, n): each round sums the gradients of all blocks where they are
    held. Rows are sorted, so that sums have one order."""
    sc = spans.sparkSession.sparkContext
    judged = sc.broadcast(truth)
    packed = spans.repartition(max(1, -(-groups // BLOCK)), "pattern", "around").sortWithinPartitions("pattern", "around").mapInArrow(_packer, "block binary")
    blocks = packed.rdd.map(lambda r: _block(*np.frombuffer(r[0], np.int64).reshape(3, -1), judged.value)).persist(StorageLevel.MEMORY_AND_DISK)

    def slopes(w):
        return sum(blocks.map(lambda b: _slope(w, *b)).collect(), np.zeros(WEIGHTS + 1))

    try:
        return _classifier(slopes, truth, total, known)
    finally:
        blocks.unpersist()


def fit(documents: DataFrame, names: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int | None = None) -> Model:
    """Train on all documents and all names. Only where a caller sets ``sample`` it is that many documents, the same ones
    for the same table."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    texts = documents.where(F.col(text).isNotNull())
    if sample is not None:
        texts = texts.orderBy(F.xxhash64(F.col(doc_id)), doc_id).limit(sample)
    texts = texts.select(F.col(text).cast("string").alias("text"))
    listed = names.select(F.col("name_text").cast("string"), F.col("name_kind").cast("string")).where("name_text is not null and name_kind in ('given', 'family')")
    counted = listed.mapInArrow(_name_endings, "name string, kind string, ending long").where("name != ''").distinct().groupBy("kind", "ending").count()
    with Workspace(spark, "privacy") as space:
        vocabulary, table, own = side_by_side([
            lambda: space.put(texts.mapInArrow(_word_counter, "word string, capital boolean, n long").groupBy("word", "capital").agg(F.sum("n").alias("n")), "words"),
            lambda: gazetteer(names),
            lambda: counted.collect(),
        ])
        n_texts = vocabulary.where("word is null").agg(F.sum("n")).first()[0] or 0
        (capital, small), known = _often(n_texts), _weight(n_texts)
        common, other = side_by_side([
            lambda: vocabulary.where(F.col("n") > F.when(F.col("capital"), capital).otherwise(small)).where("word is not null").select("word").collect(),
            lambda: vocabulary.where("capital").select("word").mapInArrow(_other_endings(sc.broadcast(table)), "ending long").groupBy("ending").count().collect(),
        ])
        endings = {kind: {r[1]: r[2] for r in own if r[0] == kind} for kind in ("given", "family")}
        words = learn_words({**endings, "other": dict(map(tuple, other))}, table, frozenset(r[0].lower() for r in common))
        found_in = texts.mapInArrow(_span_counter(sc.broadcast(pickle.dumps(words))), "pattern int, around long, n long")
        spans = space.put(found_in.groupBy("pattern", "around").agg(F.sum("n").alias("n")), "spans")
        patterns = spans.groupBy("pattern").agg(F.sum("n"), F.count("*")).collect()
        truth, tables = _judge({r[0]: r[1] for r in patterns}, known)
        weights = _trained(spans, truth, sum(r[2] for r in patterns), sum(r[1] for r in patterns), known)
    return Model(words, weights, tables)


def _finder(sent):
    def run(batches):
        model = pickle.loads(sent.value)
        for b in batches:
            rows, kinds, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for start, end, kind in model.spans(t):
                    rows.append(i)
                    kinds.append(kind)
                    texts.append(t[start:end])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "pii_type", "pii_text"])

    return run


def _redactor(sent):
    def run(batches):
        model = pickle.loads(sent.value)
        for b in batches:
            out, counts = [], []
            for t in b.column(1).to_pylist():
                if t is None:
                    out.append(None)
                    counts.append(0)
                    continue
                parts, at = [], 0
                spans = model.spans(t)
                for start, end, kind in spans:
                    parts += [t[at:start], f"[{kind.upper()}]"]
                    at = end
                out.append("".join(parts) + t[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"])

    return run


def _sent(documents: DataFrame, model: Model):
    model.words.forget()
    return documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))


def found(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text), distinct."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_finder(_sent(documents, model)), "doc_id long, pii_type string, pii_text string").distinct()


def redacted(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced): the texts with typed placeholders, everything else as it was."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_redactor(_sent(documents, model)), "doc_id long, text string, n_replaced int")
