"""Parts of person and organisation names as people type them."""

from __future__ import annotations

import math
import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations

import numpy as np

# Titles and forms of address.
TITLES = frozenset("dr prof dipl ing med jur rer nat phil habil herr frau hr fr mr mrs ms miss sir mag msc bsc phd univ pd priv doz hon h c dres".split()) - {"h", "c"}

# Short forms and pet names of given names, under the given name meant; German
# ones, then English ones.
PET_NAMES = {
    "alexander": "alex sascha xandi lex", "andreas": "andi andy anderl", "anna": "anni anja", "barbara": "baerbel babsi barbi babs", "benjamin": "ben benni",
    "bernhard": "bernd hardy", "brigitte": "gitte gitti", "charlotte": "lotte lotti", "christian": "chris christl krischan", "christine": "tine tina christl",
    "daniel": "dani dan", "dorothea": "dora dorle doro thea", "eduard": "edi ede eddy", "elisabeth": "lisa lise liesl sissi elli betti else lisbeth", "ferdinand": "ferdi",
    "franziska": "franzi sissy", "friedrich": "fritz fred friedel", "gabriele": "gabi gaby", "georg": "schorsch joerg", "gerhard": "gerd gert", "gertrud": "trude traudl",
    "gottfried": "friedel gottl", "guenther": "guenni", "heinrich": "heinz heiner hinnerk heini", "helmut": "helle", "hermann": "menne", "hildegard": "hilde",
    "ignatius": "iggy naz ignaz", "jakob": "jockel", "johannes": "hans hannes jo johann", "josef": "sepp jupp pepi joseph josi", "karl": "kalle charly", "katharina": "kathi kati kathrin katja",
    "klauspeter": "kp klaus-peter", "konrad": "conny kuno", "kunigunde": "gundi", "leonhard": "leo hardl", "leopold": "poldi", "ludwig": "lutz wiggerl lui", "magdalena": "leni lena", "manfred": "manni fred",
    "margarete": "grete gretl greta margit gretel", "maria": "mia mitzi", "martin": "tino", "matthias": "matze hias", "maximilian": "max maxl maxi", "michael": "michi michel mike",
    "nikolaus": "klaus niko nick niki", "otto": "ottl", "peter": "piet", "philipp": "phil philip lipp", "rosemarie": "rosi romy rosie", "rudolf": "rudi rolf", "sabine": "bine", "sebastian": "basti wastl bastian",
    "siegfried": "sigi", "stefan": "steff", "susanne": "susi sanne", "theodor": "theo", "theodora": "dora theda thea dorli", "therese": "resi", "thomas": "tom", "ulrich": "uli ulli", "ursula": "uschi ulla", "valentin": "valli",
    "veronika": "vroni vera", "viktor": "vicky", "walburga": "burgi", "waltraud": "traudi", "walter": "walli walt waldi", "wilhelm": "willi willy wilm", "wilhelmine": "minna", "wolfgang": "wolf wolfi", "xaver": "xaverl xari veri", "zacharias": "zach zacher zachi",
    "anthony": "tony", "catherine": "cathy kate katie", "charles": "charlie chuck", "david": "dave", "deborah": "debbie", "donald": "don", "edward": "eddie ned ted", "elizabeth": "liz beth betty eliza", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny",
    "kenneth": "ken", "lawrence": "larry", "margaret": "maggie meg peggy", "matthew": "matt", "nicholas": "nick", "patricia": "pat patty trish", "richard": "dick rick rich", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam", "steven": "steve", "timothy": "tim", "william": "bill billy will liam",
}
PET = {s: full for full, short in PET_NAMES.items() for s in short.split()}
#: Pet names that more than one given name shares.
SHARED = {s: frozenset(f for f, short in PET_NAMES.items() if s in short.split()) for s in {x for short in PET_NAMES.values() for x in short.split()}}

# Legal forms, as they read when folded and written without blanks or stops.
FORMS = {
    "gesellschaftmitbeschraenkterhaftung": "gmbh", "gesmbh": "gmbh", "gmbh": "gmbh", "mbh": "mbh", "aktiengesellschaft": "ag", "ag": "ag", "eingetragenerverein": "ev", "ev": "ev",
    "gmbhcokg": "gmbhcokg", "gmbhundcokg": "gmbhcokg", "gesellschaftmitbeschraenkterhaftungcokg": "gmbhcokg", "gesellschaftmitbeschraenkterhaftungundcokg": "gmbhcokg", "gmbhcokommanditgesellschaft": "gmbhcokg",
    "kommanditgesellschaft": "kg", "kg": "kg", "ohg": "ohg", "se": "se", "ug": "ug", "ltd": "ltd", "inc": "inc", "eg": "eg", "gbr": "gbr", "kgaa": "kgaa", "stiftung": "stiftung",
}
_LONGEST_FORM = 7

# Common words of kinds of organisation. What else is one is learned from the names
# themselves (``names.kind_words``), and abbreviations are read by a rule.
KIND_WORDS = tuple(
    "fuer for of amt anstalt akademie agentur bank betriebe buero bundesamt dienst entsorgungswerk fabrik forschungszentrum gesellschaft hochschule ingenieurbuero institut kernkraftwerk klinik kraftwerk krankenhaus labor landesamt materialpruefanstalt messstelle ministerium "
    "reaktorsicherheit rueckbau stadtwerke strahlenschutz stiftung technik universitaet verband verein verlag werk werke zentrum agency association bank center centre college company department foundation hospital industries institute laboratory ministry office partners services university".split()
)

_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ê": "e", "á": "a", "à": "a", "â": "a", "ó": "o", "ò": "o", "ô": "o", "ú": "u", "ù": "u", "í": "i", "ì": "i", "ç": "c", "ñ": "n", "ë": "e", "ï": "i"})


def fold(text: str) -> str:
    """Lower case, no accents, digits read for letters taken back, blanks made single."""
    t = text.lower().translate(_FOLD)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", t)
    t = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", t)
    t = re.sub(r"(?<=[a-z])5(?=[a-z])", "s", t)
    return re.sub(r"\s+", " ", t).strip()


def osa(a: str, b: str, limit: int) -> int:
    """Edits with neighbouring exchanges between two words; limit + 1 if more than that."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    two: list[int] = []
    one = list(range(lb + 1))
    for i in range(1, la + 1):
        cur, ca = [i] + [limit + 1] * lb, a[i - 1]
        for j in range(max(1, i - limit), min(lb, i + limit) + 1):
            d = one[j - 1] + (ca != b[j - 1])
            if one[j] + 1 < d:
                d = one[j] + 1
            if cur[j - 1] + 1 < d:
                d = cur[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1] and two[j - 2] + 1 < d:
                d = two[j - 2] + 1
            cur[j] = d
        if min(cur) > limit:
            return limit + 1
        two, one = one, cur
    return min(one[lb], limit + 1)


def osa_all(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """``osa`` of many pairs of words at once; above a pair's limit only that it is above.
    Words whose lengths differ by more than the limit are not compared."""
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    out = np.asarray(limits) + 1
    todo = np.flatnonzero(abs(la - lb) <= limits)
    for n in np.unique(la[todo]):
        rows = todo[la[todo] == n]
        m = lb[rows].max()
        x = np.array([list(map(ord, a[r])) for r in rows], np.int32).reshape(len(rows), n)
        y = np.array([list(map(ord, b[r].ljust(m, "\0"))) for r in rows], np.int32).reshape(len(rows), m)
        two, one = None, np.tile(np.arange(m + 1), (len(rows), 1))
        for i in range(1, n + 1):
            cur = np.full_like(one, i)
            for j in range(1, m + 1):
                d = np.minimum(one[:, j - 1] + (x[:, i - 1] != y[:, j - 1]), np.minimum(one[:, j], cur[:, j - 1]) + 1)
                if i > 1 and j > 1:
                    swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    d = np.where(swap, np.minimum(d, two[:, j - 2] + 1), d)
                cur[:, j] = d
            two, one = one, cur
        out[rows] = one[np.arange(len(rows)), lb[rows]]
    return out


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


_NO_LETTER = re.compile(r"[\W_]+")


def is_given(word: str, givens: frozenset[str] = frozenset()) -> bool:
    """Whether a folded word is known as a given name: by the fixed values or by ``givens``."""
    return word in PET_NAMES or word in PET or word in givens


def person(text: str, givens: frozenset[str] = frozenset()) -> tuple[str, str, str]:
    """(given name or '', initial, family name) of a person's name as typed. A name whose last
    word is a known given name and whose first isn't has its family name first."""
    t = fold(text)
    t = re.sub(r"\bdipl\.?-?\s?ing\b\.?|\bdr\.?-ing\b\.?|\bherr/frau\b", " ", t)
    last = ""
    if "," in t:
        last, _, t = t.partition(",")
        last = last.strip()
    words = [w for w in re.split(r"[\s/]+", t.replace(".", ". ")) if w.strip(".-'")]
    words = [w for w in words if w.strip(".-") not in TITLES or w == "phil"]  # the pet name, not the degree
    if last:
        lw = [w.strip(".-") for w in last.split() if w.strip(".-") and w.strip(".-") not in TITLES]
        last = "".join(lw)
    elif words:
        if len(words) > 1 and is_given(words[-1].strip(".-'"), givens) and not is_given(words[0].strip(".-'"), givens) and len(words[0].strip(".-'")) > 1:
            words = words[1:] + words[:1]
        last = words.pop().strip(".-'")
        while words and words[-1].strip(".") in ("von", "van", "zu", "de", "der"):
            words.pop()
    names = [w.strip(".-'") for w in words]
    full = [n for n in names if len(n) > 1]
    first = names[0] if names else ""
    given = ""
    if full and len(first) > 1:
        given = first.replace("-", "") if first not in PET else PET[first]
        if given in PET and given not in PET_NAMES:
            given = PET[given]
    return given, (given or first)[:1], _NO_LETTER.sub("", last)


def _form(words: list[str]) -> tuple[list[str], str]:
    for n in range(min(_LONGEST_FORM, len(words) - 1), 0, -1):
        f = FORMS.get(_NO_LETTER.sub("", "".join(words[-n:])))
        if f:
            return words[:-n], f
    return words, ""


def _within(short: str, word: str) -> bool:
    """Whether the letters of ``short`` come in ``word`` in their order, the first at its start."""
    at = iter(word)
    return short[:1] == word[:1] and all(c in at for c in short)


def is_short_for(word: str, kind: str) -> bool:
    """Whether a word of few letters shortens a kind of at least twice as many."""
    return len(kind) >= 2 * len(word) and _within(word, kind)


def kind_of(word: str, cut: bool, kinds: tuple[str, ...]) -> str:
    """The kind of organisation that a folded word means: itself, one with few typing errors, or
    one that it abbreviates (if it is cut off with a stop or has at most four letters: letters
    of the kind in their order); else ''. Of several the one that comes first in ``kinds``."""
    if word in kinds:
        return word
    if len(word) >= 4 and not cut:
        lim = 1 if len(word) < 6 else 2 if len(word) < 12 else 3
        close = [(osa(word, k, lim), i) for i, k in enumerate(kinds) if abs(len(k) - len(word)) <= lim and len(k) >= 4]
        close = [c for c in close if c[0] <= lim]
        if close:
            return kinds[min(close)[1]]
    if cut or len(word) <= 4:
        begins = [k for k in kinds if k.startswith(word) and (cut or len(word) > 1)]
        inside = begins or [k for k in kinds if is_short_for(word, k) or cut and _within(word, k)]
        if not inside and cut and len(word) >= 4:
            inside = [k for k in kinds if len(k) > len(word) and osa(word, k[: len(word)], 1) <= 1]
        return inside[0] if inside else ""
    return ""


@lru_cache(maxsize=100_000)
def _kind_of(word: str, cut: bool, kinds: tuple[str, ...]) -> str:
    return kind_of(word, cut, kinds)


def name_words(text: str) -> tuple[list[tuple[str, bool]], str]:
    """([(folded word, whether cut off with a stop)], legal form or '') of an organisation's name.
    What is joined to a cut-off word by a hyphen belongs to it."""
    t = fold(text).replace(",", " ")
    words, form = _form([w for w in t.split() if w])
    if not form and len(words) > 2:  # a typing error in the form
        tail = re.sub(r"[^a-z]", "", words[-1])
        hit = [f for f in FORMS if len(f) > 6 and osa(tail, f, 2) <= 2]
        if hit:
            words, form = words[:-1], FORMS[hit[0]]
    out = []
    for w in re.split(r"[\s&]+|(?<!\.)-|(?<=\.)(?=[a-z])", " ".join(words)):
        w = (w or "").strip("'()\"-")
        cut = w.endswith(".") or ".-" in w
        w = _NO_LETTER.sub("", w)
        if w:
            out.append((w, cut))
    return out, form


def organisation(text: str, kinds: tuple[str, ...] = KIND_WORDS) -> tuple[str, str, str]:
    """(kind, legal form or '', proper name) of an organisation's name as typed. The proper name is
    what is no word of a kind, in alphabetical order; where nothing else is, the words of
    the kinds."""
    words, form = name_words(text)
    found, proper = [], []
    for w, cut in words:
        k = _kind_of(w, cut, kinds)
        (found if k else proper).append(k or w)
    if not proper:
        return "", form, "".join(sorted(found))
    return "+".join(sorted({k for k in found if k not in _LINKS})), form, "".join(sorted(proper))


# Words between others that initials leave out.
_LINKS = frozenset("fuer for of und and the der die das".split())


def initials(text: str) -> str:
    """First letters of the words of an organisation's name of three words or more, else ''."""
    words = [w for w, _ in name_words(text)[0] if w not in _LINKS]
    return "".join(w[0] for w in words) if len(words) > 2 else ""


def given_alike(a: str, b: str) -> int:
    """Edits between two given names, 0 for pet names of one another; 9 if they differ."""
    if a == b:
        return 0
    fa, fb = SHARED.get(a, frozenset()) | {PET.get(a, a)}, SHARED.get(b, frozenset()) | {PET.get(b, b)}
    if fa & fb:
        return 0
    lim = min(allowed(a), allowed(b))
    d = osa(a, b, lim)
    return d if d <= lim and SequenceMatcher(None, a, b).ratio() >= 0.6 else 9


#: Words of more letters have no keys of all their letters, but of their ends.
LONG, _END = 20, 10


@lru_cache(maxsize=200)
def _kept(n: int, left_out: int) -> np.ndarray:
    return np.array(list(combinations(range(n), n - left_out)), np.intp)


def _hashes(word: str, most: int, salt: int) -> list[np.ndarray]:
    """Hashes of the word with up to ``most`` letters left out."""
    codes, n = np.array(list(map(ord, word)), np.uint64) * np.uint64(0x9E3779B97F4A7C15), len(word)
    codes ^= codes >> np.uint64(29)
    powers = np.cumprod(np.full(n + 1, 0xBF58476D1CE4E5B9, np.uint64)) + np.uint64(salt)
    return [np.unique((codes[_kept(n, i)] * powers[: n - i]).sum(1, dtype=np.uint64) + powers[n - i]) for i in range(min(most, n) + 1)]


def edit_keys(word: str, most: int, kind: str = "", letters: int = 3) -> np.ndarray:
    """Keys of which any two words within min(most, max(1, letters of the shorter // ``letters``))
    edits share one, for ``most`` up to 4.

    Words within k edits become equal by leaving out up to k letters of each. Of words over
    LONG letters the first and the last _END letters can't both have more than two of up to
    four edits, and what an end turns into has up to two letters more or less; the shorter
    of such a pair may have LONG + 1 - most letters. Digits are part of every key: numbered
    names share none."""
    n, salt = len(word), sum(map(ord, kind)) * 8
    number = "".join(filter(str.isdigit, word))
    if number:
        salt += 8 * (hash_text(number) % (1 << 40)) + 8
    found = _hashes(word, min(most, max(1, n // letters)), salt) if n <= LONG else []
    if n > LONG - most:
        for j in range(_END - 2, _END + 3):
            found += _hashes(word[:j], 2, salt + 2) + _hashes(word[-j:], 2, salt + 4)
    return np.unique(np.concatenate(found)).astype(np.int64)


def end_keys(word: str, salt: int, end: int = 8) -> np.ndarray:
    """Keys of which two words of 2 * ``end`` letters or more within four edits share one: their
    first and their last ``end`` letters can't both have more than two edits."""
    found = []
    for j in range(end - 2, end + 3):
        found += _hashes(word[:j], 2, (salt + 1) % (1 << 60)) + _hashes(word[-j:], 2, (salt + 3) % (1 << 60))
    return np.unique(np.concatenate(found)).astype(np.int64)


def hash_text(text: str) -> int:
    """A number for a text, the same in every process."""
    out = 1469598103934665603
    for b in text.encode():
        out = ((out ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return out


# Letters of a name as numbers; all that aren't Latin letters or digits are one. 0 is the edge.
_SYMBOLS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}
N_SYMBOLS = len(_SYMBOLS) + 2


def fours(word: str) -> np.ndarray:
    """The runs of four letters of a word with its edges, as numbers below N_SYMBOLS to the fourth."""
    c = np.array([0, 0, 0, *(_SYMBOLS.get(x, N_SYMBOLS - 1) for x in word), 0], np.int64)
    return ((c[:-3] * N_SYMBOLS + c[1:-2]) * N_SYMBOLS + c[2:-1]) * N_SYMBOLS + c[3:]


class Spelling:
    """How likely letters follow each other in the names of the data: counts of runs of four
    letters, smoothed by those of three and two. ``usual(xs, ys)`` are the log-probabilities
    that a name is spelled x, each by all names but x and y themselves."""

    def __init__(self, counts: dict[int, int]):
        n = N_SYMBOLS
        self.four = np.zeros(n**4, np.float32)
        self.four[list(counts)] = list(counts.values())
        cube = self.four.reshape(n, n, n, n)
        self.before3, last3 = cube.sum(3).ravel(), cube.sum(0)
        self.last3, self.before2, last2 = last3.ravel(), last3.sum(2).ravel(), last3.sum(0)
        self.last2, self.before1 = last2.ravel(), last2.sum(1)

    def usual(self, xs: list[str], ys: list[str]) -> np.ndarray:
        out = np.zeros(len(xs))
        tx, ty = [fours(x) for x in xs], [fours(y) if y != x else fours(x)[:0] for x, y in zip(xs, ys)]
        size = np.array([len(x) * (len(x) + len(y)) for x, y in zip(tx, ty)], np.int64)
        order, lo = np.argsort(size, kind="stable"), 0
        while lo < len(order):  # pairs of about one size at a time, so that little is padded
            hi = min(len(order), lo + max(1, 2_000_000 // int(size[order[min(len(order) - 1, lo + 2000)]] + 1)))
            rows = order[lo:hi]
            out[rows] = self._usual([tx[r] for r in rows], [ty[r] for r in rows])
            lo = hi
        return out

    def _usual(self, tx: list[np.ndarray], ty: list[np.ndarray]) -> np.ndarray:
        n = N_SYMBOLS
        x = np.full((len(tx), max(map(len, tx))), -1, np.int64)
        z = np.full((len(tx), x.shape[1] + max(map(len, ty))), -1, np.int64)
        for i, (a, b) in enumerate(zip(tx, ty)):
            x[i, : len(a)], z[i, : len(a)], z[i, len(a) : len(a) + len(b)] = a, a, b
        live = x >= 0

        def left(table: np.ndarray, part) -> np.ndarray:
            """What a table counts for each run of x beside those of x and y."""
            own = ((part(x)[:, :, None] == part(z)[:, None, :]) & (z >= 0)[:, None, :]).sum(2)
            return np.maximum(0, table[part(np.maximum(x, 0))] - own)

        two = (left(self.last2, lambda t: t % n**2) + 2 / 30) / (left(self.before1, lambda t: t % n**2 // n) + 2)
        three = (left(self.last3, lambda t: t % n**3) + 2 * two) / (left(self.before2, lambda t: t % n**3 // n) + 2)
        p = (left(self.four, lambda t: t) + 2 * three) / (left(self.before3, lambda t: t // n) + 2)
        return np.where(live, np.log(p), 0.0).sum(1)


# Share of names typed with 0, 1, ... errors, as logarithms; and of one error among all places
# and letters of a word, for each of its letters.
_ERRORS = [math.log(x) for x in (0.6, 0.2, 0.1, 0.06, 0.04)]
_CHOICES = 60


def mistyped(n, d, letters, usual):
    """Log-odds that a spelling on ``n`` records, ``d`` edits from another one, is that one typed
    wrong (the same way each time) and not a name of its own, which has the log-probability
    ``usual``. Every record tells against the error; a name that is usual is rather one.
    For numbers or arrays of them."""
    return n * (np.array(_ERRORS)[d] - d * np.log(_CHOICES * np.maximum(letters, 1))) - usual
