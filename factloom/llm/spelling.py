"""Names as people type them: cutting into parts and comparing two of them (used by ``names``)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping

# Forms of address, legal forms, joining words, general references, and short forms of given names.
HONORIFICS = {"mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "shri", "sri", "smt", "kumari", "sir", "messrs", "m/s", "er", "ca", "adv"}
LEGAL = {"ltd", "limited", "corp", "corporation", "gmbh", "llp", "llc", "plc", "pvt", "private", "inc", "incorporated", "holdings", "holding", "co", "company", "ag", "sa", "nv", "bv", "pte", "p", "pl", "lt"}
JOINING = {"&", "and", "the", "of"}
GENERAL = {"company", "parent", "group", "bank", "issuer", "firm", "entity", "organisation", "organization", "corporation", "subsidiary", "management", "board", "undertaking", "business", "lender", "borrower", "registrant"}
DETERMINERS = {"the", "our", "this", "said", "its", "their", "your", "a", "that"}
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex alec sandy xander al sasha", "alexandra": "alex sandra lexi sandy alexa sasha", "ananthi": "anu", "anthony": "tony ant", "benjamin": "ben benny benji",
    "catherine": "cathy kate kat cat", "charles": "charlie chuck chas", "christina": "chris tina christy chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie",
    "devendra": "dev deven", "dorothy": "dot dottie dolly dora", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora ella", "elizabeth": "liz beth betty lizzie eliza bess lisa", "frederick": "fred freddie freddy rick",
    "gerald": "gerry jerry", "harinder": "harry", "harold": "harry hal", "henry": "harry hank hal", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny jon", "jonathan": "jon jonny nathan johnny",
    "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy kat katie kitty kath", "kenneth": "ken kenny", "krishnan": "krish kris kittu", "lakshmi": "laxmi lux lucky", "lawrence": "larry laurie", "leonard": "leo len", "margaret": "maggie meg peggy marge madge greta",
    "matthew": "matt matty", "michael": "mike mick mickey", "nicholas": "nick nicky", "padmanabhan": "paddy padma padu", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rajendra": "raj raja raju rajan rajen", "raymond": "ray",
    "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samantha": "sam sammy", "samuel": "sam sammy", "sarah": "sally", "srinivas": "srini sri vasu", "stephen": "steve steph stevie", "subramaniam": "subbu mani subra", "subramanian": "subbu mani",
    "susan": "sue susie", "susannah": "sue susie anna sukie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "venkatesh": "venky venkat", "victoria": "vicky tori vic vicki", "walter": "walt", "william": "will bill billy liam willy",
}


class Nicknames:
    """Short forms of given names: a table of full names with their short forms, separated by blanks."""

    def __init__(self, table: Mapping[str, str]):
        self.short = {full: set(forms.split()) for full, forms in table.items()}
        self.full: dict[str, set[str]] = {}
        for full, forms in self.short.items():
            for form in forms:
                self.full.setdefault(form, set()).add(full)

    def forms(self, word: str) -> list[str]:
        """Given names that a word may stand for, and short forms of it."""
        return sorted(self.full.get(word, set()) | self.short.get(word, set()))

    def likeness(self, a: str, b: str) -> float | None:
        """How alike two given names are; None where the table does not say."""
        if a in self.short and b in self.short:
            return 0.0
        full_a, full_b = self.full.get(a, set()), self.full.get(b, set())
        return 0.95 if b in full_a or a in full_b else 0.9 if full_a & full_b else None


KNOWN = Nicknames(NICKNAMES)
CUT = re.compile(r"[^\w&/]+|_", re.UNICODE)


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words_of(name: str | None) -> list[str]:
    """All words of a name as typed, in plain letters."""
    if not name:
        return []
    text = plain(re.sub(r"(?i)\bm/s\b\.?", " ", name).replace("'", "").replace("’", ""))
    return [w for x in CUT.split(text) if (w := x.strip("/"))]


def telling(words: list[str]) -> list[str]:
    """The words that tell parties apart; none for a general reference ("the Company")."""
    if words and len(words) <= 3 and words[-1] in GENERAL and all(w in DETERMINERS for w in words[:-1]):
        return []
    return [w for w in words if w not in JOINING and w not in LEGAL and w not in HONORIFICS]


def parts(name: str | None) -> list[str]:
    return telling(words_of(name))


def rejoined(name: str | None) -> list[list[str]]:
    """The readings of a name with two neighbouring words taken as one word that a blank got into."""
    words = words_of(name)
    out = []
    for k in range(len(words) - 1):
        a, b = words[k], words[k + 1]
        if min(len(a), len(b)) >= 3 and not {a, b} & LEGAL:
            out.append(telling([*words[:k], a + b, *words[k + 2 :]]))
    return [x for x in out if x]


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words (insert, delete, replace, swap of neighbours), ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def allowed(size: int) -> int:
    """Edits that a word of this length may differ by."""
    return 0 if size < 4 else 1 if size < 8 else 2


def abbreviates(short: str, word: str) -> bool:
    """Whether a short form keeps the first letter and the order of the letters of a word."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in short)


def likeness(a: str, b: str, common_a: bool, common_b: bool, names: Nicknames = KNOWN) -> float:
    """How alike two words are, 0 to 1; short forms count only for common words."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    if (said := names.likeness(a, b)) is not None:
        return said
    if (common_b and abbreviates(a, b)) or (common_a and abbreviates(b, a)):
        return 0.9
    most = allowed(min(len(a), len(b)))
    if most and (d := edits(a, b, most)) <= most:
        return 1 - d / max(len(a), len(b), 6)
    return 0.0


def fused(words: list[str], rare: list[bool]) -> list[str]:
    """Neighbouring words, of which one is rare, written as one in either order."""
    return [x for k, (a, b) in enumerate(zip(words, words[1:])) if len(a) > 3 and len(b) > 3 and (rare[k] or rare[k + 1]) for x in (a + b, b + a)]


def weight(df: int, total: int) -> float:
    return math.log(1 + total / max(df, 1))


def letters_of(words: list[str]) -> str:
    """The initials that a name gives instead of words: its single letters, else a first word of two or three letters."""
    letters = "".join(w for w in words if len(w) == 1)
    return letters if len(letters) >= 2 else words[0] if not letters and words and 2 <= len(words[0]) <= 3 else ""


def short_form(a: list[str], df_a: list[int], b: list[str], df_b: list[int], total: int, common: int) -> float:
    """Soft weighted similarity of a name that is cut down to initials, or to the first rare word, and its trade; 0 if it is not.

    Initials count as far as an initial is like a word, rare words that were left out count by a third; all of the
    name's trade words need a match among the other's.
    """
    rare_b = [(w, weight(n, total)) for w, n in zip(b, df_b) if n < common]
    trade_b = [w for w, n in zip(b, df_b) if n >= common]
    letters = letters_of(a) if all(len(w) <= 3 or n >= common for w, n in zip(a, df_a)) else ""
    rare_a = [w for w, n in zip(a, df_a) if n < common]
    if len(letters) >= 2 and letters == "".join(w[0] for w, _ in rare_b):
        got, whole = 0.6 * sum(w for _, w in rare_b), sum(w for _, w in rare_b)
        trade = [w for w in a if len(w) > 1 and w != letters]
    elif len(rare_a) == 1 and rare_a[0] == a[0] and len(a[0]) >= 4 and len(rare_b) > 1 and rare_b[0][0] == b[0]:
        d, most = edits(a[0], b[0], 2), 2 if len(a[0]) >= 8 else 1
        if d > most:
            return 0.0
        got = (1 - d / max(len(a[0]), len(b[0]), 6)) * rare_b[0][1]
        whole = rare_b[0][1] + sum(w for _, w in rare_b[1:]) / 3
        trade = [w for w, n in zip(a, df_a) if n >= common]
    else:
        return 0.0
    like = [max((likeness(x, y, True, True) for y in trade_b), default=0.0) for x in trade]
    if not like or min(like) < 0.85:
        return 0.0
    w = weight(common, total)
    return (got + w * sum(like)) / (whole + w * len(like))


def similarity(a: list[str], df_a: list[int], b: list[str], df_b: list[int], total: int, common: int, names: Nicknames = KNOWN) -> tuple[float, bool]:
    """(similarity, uses_initial) of two names by soft weighted word similarity.

    Words are matched one to one, best first, and count by their rarity over the registered names. A rare word that matches nothing
    counts in full, a common one (a trade) only in part unless both names have one; extra initials do not count. Common words alone make no match.
    """
    wa, wb = [weight(x, total) for x in df_a], [weight(x, total) for x in df_b]
    ca, cb = [x >= common for x in df_a], [x >= common for x in df_b]
    free_a, free_b = set(range(len(a))), set(range(len(b)))
    got = whole = 0.0
    initial = strong = False
    for x, y, wx, wy, fx, fy in ((a, b, wa, wb, free_a, free_b), (b, a, wb, wa, free_b, free_a)):
        for i, word in enumerate(x):
            if len(word) < 8 or i not in fx:
                continue
            for j in range(len(y) - 1):
                pair = (y[j] + y[j + 1], y[j + 1] + y[j])
                if j in fy and j + 1 in fy and len(y[j]) > 3 and len(y[j + 1]) > 3 and min(edits(word, p, 1) for p in pair) <= 1:
                    fx.discard(i), fy.discard(j), fy.discard(j + 1)
                    got += wy[j] + wy[j + 1]
                    strong = True
                    whole += wy[j] + wy[j + 1]
                    break
    pairs = sorted(((likeness(a[i], b[j], ca[i], cb[j], names), (wa[i] + wb[j]) / 2, -i, -j) for i in free_a for j in free_b), reverse=True)
    for like, w, i, j in pairs:
        i, j = -i, -j
        if like <= 0 or i not in free_a or j not in free_b:
            continue
        free_a.discard(i), free_b.discard(j)
        by_initial = len(a[i]) == 1 or len(b[j]) == 1
        if by_initial:
            w = max(wa[i], wb[j]) if len(a[i]) == len(b[j]) else (wb[j] if len(a[i]) == 1 else wa[i])
            initial |= len(a[i]) != len(b[j])
        strong |= not by_initial and not (ca[i] and cb[j])
        got += like * w
        whole += w
    left_a = [(wa[i], ca[i]) for i in free_a if len(a[i]) > 1]
    left_b = [(wb[j], cb[j]) for j in free_b if len(b[j]) > 1]
    # an initial that fits no word of the other name speaks against it unless that name is used up
    against = (left_a and len(left_b) < len(free_b)) or (left_b and len(left_a) < len(free_a))
    both = against or (any(c for _, c in left_a) and any(c for _, c in left_b))
    for w, c in left_a + left_b:
        whole += w * (1.0 if not c else 1.0 if both else 0.15)
    if not strong:
        return 0.0, initial
    return got / whole, initial
