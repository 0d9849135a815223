"""Which single-byte charset a text is written in, by statistics of its bytes.

Every pair of a charset and a language written in it is a hypothesis. Bytes beyond ASCII are weighed by what they stand
for under it: letters of the language by how common they are (by Zipf's rule on the order in which LANGUAGES lists
them), other letters, signs and places without a character against it. Pairs of neighbouring bytes are weighed by
the classes of the two: scripts do not change within a word, capitals do not follow small letters but each other, signs
stand between words, marks stand on letters, final forms end a word, and vowels and consonants take turns. All of it is a
product of byte and pair counts with fixed tables, so a text is read once however many hypotheses there are. Texts all in
capitals are hypotheses of their own. Different words are counted, each once, as repetition tells nothing new about the charset.

The confidence is 100 times the product of three shares: how far the best hypothesis is ahead of the best one that reads the
text differently, how well the text fits it, and how many different letters speak for it. Hypotheses that read the
text alike are one; the first charset in CHARSETS that reads it so is named.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np

#: Letters that are not ASCII, by language, common ones first.
LANGUAGES = {
    "ru": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "uk": "оанитвеірсклудмпязбгйьчхцїжющєшфґ",
    "bg": "аеионтрсвлкдпмзгубчщйяжцхшюфъь",
    "el": "αοιετνσηυρπκμλςάόίδέγύήωθχφώβξζψϊϋΐΰ",
    "he": "יוהלארתבשמנםדקעחפכטגןזסצךףץ",
    "ar": "المينرتبةعدسفهوكقأحجشصطخىزضإذغثآءئؤظ",
    "th": "านรอก่งเ้มัยลิวดีทสุตะปบคหแจพใไชขูำศณธื์็ถฉซญผฟฐฮฝโภษึๆ๊ฎฤฌฏฒ๋ฑ",
    "vi": "đ̣́̀âêôửăỡàáèéìíòóùúý",
    "fr": "éèàêçâôîùûœïëü",
    "es": "óíáéñúü",
    "pt": "ãçéáíóêõâúôà",
    "it": "èàòùéìó",
    "de": "üäöß",
    "sv": "äåöé",
    "da": "øåæé",
    "is": "ðáíóþöéúæý",
    "pl": "łżęąóśćńź",
    "cs": "íáěéžřščýůúťňďó",
    "sk": "áíéčýžšúľťňôóďäŕĺ",
    "hu": "áéöóőüíúű",
    "ro": "ăîşâţ",
    "hr": "čšžćđ",
    "tr": "ıüşçğöâî",
    "lt": "ėšųžūįąčę",
    "lv": "āīšēņūļčžķģ",
    "et": "äõüöšž",
}
#: Languages by charset; of charsets that read a text alike the first is named.
CHARSETS = {
    "windows-1252": "fr es pt it de sv da is",
    "windows-1251": "ru uk bg",
    "koi8-r": "ru",
    "koi8-u": "uk",
    "ibm866": "ru",
    "iso-8859-5": "ru uk bg",
    "windows-1250": "pl cs sk hu ro hr",
    "iso-8859-2": "pl cs sk hu ro hr",
    "windows-1253": "el",
    "iso-8859-7": "el",
    "windows-1254": "tr",
    "iso-8859-9": "tr",
    "windows-1255": "he",
    "windows-1256": "ar",
    "windows-1257": "lt lv et",
    "windows-1258": "vi",
    "windows-874": "th",
    "iso-8859-15": "fr es pt it de sv da is",
    "iso-8859-1": "fr es pt it de sv da is",
}
CODECS = {"windows-874": "cp874", "ibm866": "cp866", "koi8-r": "koi8-r", "koi8-u": "koi8-u"}
LATIN = {"vi", "fr", "es", "pt", "it", "de", "sv", "da", "is", "pl", "cs", "sk", "hu", "ro", "hr", "tr", "lt", "lv", "et"}
#: Final forms: no letter follows them.
FINAL = "ςםןךףץ"
#: Signs that stand beside letters in any text, and those that are common but stand alone.
QUIET, COMMON = "\xa0«»“”„‘’‚‹›–—…¡¿ªº°", "·§©®™€£№•½"
SINGLE = "‘’‚‹›"
#: Letters for vowels, without marks.
VOWELS = "aeiouyæøœıаеиоуыэюяієαεηιουω"
# Classes of characters.
OTHER, SMALL, CAPITAL, HIGH_SMALL, HIGH_CAPITAL, FAR_SMALL, FAR_CAPITAL, FAR_FINAL, MARK, SIGN, NONE = range(11)
#: Weights of pairs of classes, in nats.
_MIX, _CASE, _SIGN, _MARK, _NEXT, _CAPITALS, _TURNS = -4.5, -3.0, -2.0, -4.0, -0.7, 1.4, 0.4
#: Weights of single characters: a letter of another language, signs, a control character, none at all; and what a capital loses.
_STRANGER, _QUIET, _COMMON, _ODD, _CONTROL, _UNUSED, _CAPITAL = -6.0, -0.8, -1.5, -3.0, -7.0, -10.0, -1.6
#: What a text all in capitals has against it, and what the most usual charsets have ahead.
SHOUTED = -4.0
PRIOR = {"windows-1252": 3.0, "windows-1251": 1.0}
#: As many letters as a byte beyond ASCII may stand for.
ROOM = 96
#: Nats for which the lead of the best hypothesis counts half, the number of different letters that count in full, and the one
#: below which their repetition hardly counts.
LEAD, LETTERS, FEW = 2.0, 8, 5
#: Words are taken from so many bytes at a time, and so many are remembered at least before later ones can count again.
PIECE, WORDS = 1 << 20, 100_000


def pair_weights(shouted: bool) -> np.ndarray:
    w = np.zeros((11, 11))
    latin, far = (SMALL, CAPITAL, HIGH_SMALL, HIGH_CAPITAL), (FAR_SMALL, FAR_CAPITAL, FAR_FINAL)
    for a in latin:
        for b in far:
            w[a, b] = w[b, a] = _MIX
    for a, b in ((SMALL, HIGH_CAPITAL), (HIGH_SMALL, CAPITAL), (HIGH_SMALL, HIGH_CAPITAL), (FAR_SMALL, FAR_CAPITAL), (FAR_FINAL, FAR_CAPITAL)):
        w[a, b] = 0 if shouted else _CASE
    for a in (HIGH_SMALL, HIGH_CAPITAL):
        for b in (HIGH_SMALL, HIGH_CAPITAL):
            w[a, b] += _NEXT
    for a, b in ((CAPITAL, HIGH_CAPITAL), (HIGH_CAPITAL, HIGH_CAPITAL), (FAR_CAPITAL, FAR_CAPITAL)):
        w[a, b] += 0 if shouted else _CAPITALS
    for a in (*latin, *far, MARK):
        for b in (SIGN, NONE):
            w[a, b] = w[b, a] = _SIGN
    for a in (OTHER, SIGN, NONE):
        w[a, MARK] = _MARK
    for b in (FAR_SMALL, FAR_FINAL, MARK):
        w[FAR_FINAL, b] = -2.0
    return w


def classes(table: str) -> np.ndarray:
    out = []
    for b, c in enumerate(table):
        kind = unicodedata.category(c)
        if c == "�" or (b >= 0x80 and kind == "Cc"):
            out.append(NONE)
        elif kind[0] == "M":
            out.append(MARK)
        elif b < 0x80:
            out.append(SMALL if c.islower() else CAPITAL if c.isupper() else OTHER)
        elif not c.isalpha() or c in "ªº":
            out.append(OTHER if c in QUIET or c == "\xad" or kind == "Nd" else SIGN)
        elif "LATIN" in unicodedata.name(c, "") or c == "µ":
            out.append(HIGH_CAPITAL if c.isupper() else HIGH_SMALL)
        else:
            out.append(FAR_FINAL if c in FINAL else FAR_CAPITAL if c.isupper() else FAR_SMALL)
    return np.array(out)


def turns(table: str) -> np.ndarray:
    """1 for vowels, -1 for consonants, 0 for all else; scripts that write no vowels have neither."""
    out = []
    for c in table:
        base = unicodedata.normalize("NFD", c.lower())[0]
        script = unicodedata.name(base, "").split(" ")[0]
        out.append(0 if not base.isalpha() or script not in ("LATIN", "CYRILLIC", "GREEK") else 1 if base in VOWELS else -1)
    return np.array(out, dtype=float)


def letter_weights(letters: str) -> dict[str, float]:
    """ln(p * ROOM) for each letter: how much more common it is than if all bytes were alike."""
    shares = [1 / (k + 3) for k in range(len(letters))]
    return {c: math.log(s / sum(shares) * ROOM) for c, s in zip(letters, shares)}


def different_words(data: bytes) -> bytes:
    """The words with bytes beyond ASCII, each once: the others have no weight in any hypothesis."""
    seen: set[bytes] = set()
    out = []
    for i in range(0, len(data), PIECE):
        new = {w: None for w in data[i : i + PIECE].split() if not w.isascii() and w not in seen}
        if len(seen) < WORDS:
            seen.update(new)
        out.append(b" ".join(new))
    return b" ".join(out)


class Hypotheses:
    def __init__(self):
        self.names = list(CHARSETS)
        self.tables = [bytes(range(256)).decode(CODECS.get(n, n.replace("windows-", "cp")), "replace") for n in self.names]
        self.classes = np.stack([classes(t) for t in self.tables])
        self.turns = np.stack([turns(t) for t in self.tables])
        self.pairs = [pair_weights(shouted) for shouted in (False, True)]
        rows, owner, best, shouts = [], [], [], []
        for k, (name, table) in enumerate(zip(self.names, self.tables)):
            for language in CHARSETS[name].split():
                known = letter_weights(LANGUAGES[language])
                for shouted in (False, True):
                    rows.append([self.weight(c, kind, known, shouted) for c, kind in zip(table[128:], self.classes[k][128:])])
                    owner.append(k)
                    shouts.append(shouted)
                    best.append(sum(math.exp(w) / ROOM * w for w in known.values()))
        self.letters, self.owner, self.expected, self.shouts = np.array(rows), np.array(owner), np.array(best), np.array(shouts, dtype=int)
        self.prior = np.array([PRIOR.get(self.names[k], 0.0) for k in owner]) + SHOUTED * self.shouts

    @staticmethod
    def weight(c: str, kind: int, known: dict[str, float], shouted: bool) -> float:
        if c == "�":
            return _UNUSED
        if kind == NONE:
            return _CONTROL
        if c.lower() in known:
            return known[c.lower()] + (0 if kind == MARK or c.isupper() == shouted or c.lower() == c.upper() else _CAPITAL)
        if kind in (OTHER, SIGN):
            return _ODD if kind == SIGN and c not in COMMON else _COMMON if kind == SIGN or c in SINGLE else _QUIET
        return _STRANGER

    def scores(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of each hypothesis; and how often each byte beyond ASCII occurs in the different words."""
        raw = np.frombuffer(b" " + different_words(data) + b" ", dtype=np.uint8)
        counts = np.bincount(raw, minlength=256)[128:]
        pairs = raw[:-1].astype(np.int32) << 8 | raw[1:]
        pairs = pairs[(raw[:-1] | raw[1:]) >= 0x80]
        if len(pairs) > 1 << 14:
            n = np.bincount(pairs, minlength=1 << 16)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(pairs, return_counts=True)
        left, right, kinds = found >> 8, found & 255, self.classes
        both = self.turns[:, left] * self.turns[:, right]
        # In prose they take turns often enough for a mean of -0.25, so that such scripts gain nothing over others.
        alike = -_TURNS * (both + 0.25 * abs(both)) @ n
        by_charset = np.stack([w[kinds[:, left], kinds[:, right]] @ n + alike for w in self.pairs])
        return self.letters @ counts + by_charset[self.shouts, self.owner] + self.prior, counts

    def guess(self, data: bytes) -> tuple[str, int]:
        """(charset, confidence) of bytes some of which are beyond ASCII."""
        scores, counts = self.scores(data)
        used = np.flatnonzero(counts)
        best = int(scores.argmax())
        read = ["".join(t[128 + b] for b in used) for t in self.tables]
        own = read[self.owner[best]]
        rivals = [s for s, k in zip(scores, self.owner) if read[k] != own]
        high = int(counts.sum())
        lead = (scores[best] - max(rivals)) if rivals else 100.0
        fit = min(1.0, max(0.0, 0.4 + 0.8 * scores[best] / high / self.expected[best]))
        letters = sum(1 for b in used if self.classes[self.owner[best]][128 + b] in (HIGH_SMALL, HIGH_CAPITAL, FAR_SMALL, FAR_CAPITAL, FAR_FINAL, MARK))
        if letters < FEW:  # the same few letters again and again tell little more than once
            lead *= min(1.0, 2 * max(1, letters) / high)
        ahead = 1 - 0.5 ** (lead / LEAD)
        many = min(1.0, 0.7 + 0.3 * (letters - 1) / (LETTERS - 1)) if letters else 0.4
        return self.names[read.index(own)], min(99, int(100 * ahead * fit * many))


@lru_cache(maxsize=1)
def hypotheses() -> Hypotheses:
    """Made once in a process."""
    return Hypotheses()
