"""Problem 3: sentence boundaries across languages and scripts.

The rules are those of the sentence-break property of Unicode (SB3 to SB998), in their order, for every script: its ATerm, STerm,
Close, Sp, SContinue, Upper, Lower, OLetter, Numeric, Extend and Format characters. They are tailored where the property alone
is wrong:

* SB4: a blank line or a paragraph separator always ends a unit, a single line break never does.
* SB7: a full stop between a small and a capital letter ends a sentence whose blank is missing, but not in an address.
* SB8: figures don't lead to a small letter behind them, so a sentence may begin with a number.
* SB9: quotes and brackets that close behind a terminator belong to the sentence, also behind a blank as in French.
* SB11: a full stop that belongs to an abbreviation, an initial or an ordinal by language ends no sentence, unless the word may
  end one and the word that follows is one that opens sentences; a terminator inside brackets that are closed in the same
  paragraph ends none; in scripts without case a quote that opens a sentence is followed by its attribution.
* Thai and Lao end sentences by blanks between words.

Null, empty and blank texts have no sentence. Repeated rows of a page count once (`counted_pages`).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import WHITE, arrow_map, counted_pages

# Abbreviations by language. Words before a name or inside a phrase, which end no sentence; behind "#" those that
# end none before a number; behind "?" those that may end one.
_LISTS = {
    "en": "Dr Mr Mrs Ms Prof St Gen Col Capt Cpt Lt Sgt Rev Hon Gov Sen Rep Pres Mt Ft Messrs cf vs viz ca approx e.g i.e # fig figs vol vols pp p no nos No Nos Fig Vol ch sec eq art Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec ? al b d sq ed eds trans p.m a.m",
    "de": "Dr Prof Hr Fr Bd Bde St ca bzw z h o s v vgl Hrsg Hl Ing Dipl Mag Frl z.B d.h geb gest evtl ggf inkl # Nr Nrn Str Abb Abs Art Aufl Kap Jan Feb Apr Aug Sept Okt Nov Dez Tel S ? u a d ff f u.a o.ä sog Mio Mrd Jh",
    "fr": "M MM Mme Mlle Mmes Dr Pr Me St Ste éd env av apr cf c.-à-d réf # p pp t n no vol fig chap art déc janv févr avr juil sept oct nov ? J.-C ex hab etc",
    "es": "Sr Sra Sres Srta Dr Dra D Dña Prof Profa Lic Ing Gral aprox EE ej núm av avda cf p # pp pág págs vol cap art fig n ene feb abr ago sept oct nov dic ? UU Ud Uds gob",
    "it": "sig sigg sig.ra Sig Sigg Sig.ra dott dott.ssa Dott Dott.ssa prof Prof prof.ssa ing Ing avv Avv geom on Mons S ca cfr es # pag pagg p pp n art cap vol fig gen feb mar apr giu lug ago set ott nov dic ? a.C d.C ecc",
    "pt": "Sr Sra Srs Sras Dr Dra Drs Prof Profa Eng Exmo Exma Dom Sto Sta aprox cf ex # pág págs p pp n núm vol art cap fig jan fev abr ago set out nov dez ? a.C d.C etc",
    "ru": "т д им ул пл пр просп см проф акад доц обл ср напр св изд т.е # рис табл стр с ? г гг др р тыс млн млрд руб коп кв ред т.д т.п",
    "hi": "डॉ श्री नं रु प्रो पं # ? मी कि.मी सं कु",
}
# Words that open sentences more often than they are names. Fixed values.
_STARTERS = {
    "en": "the a an this that these those he she it we they i you his her its our their there here then when while where what who why how in on at by for from with without after before since until if as but and or so yet each every one both all some many most no not near under over behind beyond above along across within although because later now thus also however",
    "de": "der die das ein eine einer eines dieser diese dieses jener jede jeder jedes er sie es wir ihr ich man in im an am auf aus bei mit nach seit von vor zu über unter neben hinter zwischen gegen entlang und oder aber doch denn wenn als weil da dort dann hier heute später auch nur kein keine siehe wer was wie wo",
    "fr": "le la les un une des ce cet cette ces il elle ils elles on nous vous je son sa ses leur dans sur sous vers par pour avec sans chez entre après avant depuis et ou mais donc car si quand lorsque puis alors ici là chaque qui que quoi où comment voir",
    "es": "el la los las un una unos unas este esta estos estas ese esa aquel él ella ellos nosotros yo su sus en sobre bajo entre hacia desde con sin por para tras ante y o pero si cuando mientras luego entonces aquí cada quién qué cómo no",
    "it": "il lo la i gli le un uno una questo questa quel quella egli lui lei loro noi io si in su sotto con senza per tra fra dopo prima e o ma se quando poi allora qui ogni chi che cosa dove come non",
    "pt": "o a os as um uma este esta esse essa aquele ele ela eles nós eu seu sua em no na sobre sob com sem por para entre depois antes e ou mas se quando então depois aqui cada quem que como onde não",
    "ru": "в на за над под у из от до с со к по о об при через между около перед после он она оно они мы я вы его её их это этот эта тот та такой каждый весь один и а но или если когда пока потом затем там здесь тогда теперь также кто что как где никто",
}
_END, _NUMBER, _MAY = {}, {}, {}
for _lang, _words in _LISTS.items():
    _rest, _, _m = _words.partition("?")
    _e, _, _n = _rest.partition("#")
    _END[_lang], _NUMBER[_lang], _MAY[_lang] = (frozenset(x.split()) for x in (_e, _n, _m))
for _held in (_END, _NUMBER, _MAY):  # a language without a list of its own has the words of several letters of all
    _held[""] = frozenset(w for x in _held.values() for w in x if len(w) > 1)
_STARTERS = {k: frozenset(v.split()) for k, v in _STARTERS.items()}
_STARTERS[""] = frozenset().union(*_STARTERS.values())
_LONGEST = max(len(w) for x in (_END, _NUMBER, _MAY) for held in x.values() for w in held)
# Frequent words that tell Latin-script languages apart where the language is not given. Fixed values.
_HINTS = {
    "en": "the of and that this under near each was",
    "de": "der die das und ein eine dieser jede über",
    "fr": "le la les un une cette ce chaque dans sur et",
    "es": "el los una este esa cada entre desde y en",
    "it": "il gli della dello che sono nel una",
    "pt": "os da do uma não em são pelo",
}
_HINTS = {k: frozenset(v.split()) for k, v in _HINTS.items()}

#: A blank line or paragraph separator, a run of terminators, or a gap between two Thai or two Lao letters.
_PLACE = regex.compile(
    r"(?P<blank>[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*|[ \t\r\n]*\u2029)|(?P<end>[\p{SB=ST}\p{SB=AT}]+)|(?P<gap>(?<=\p{Script=Thai})[ \t\r\n]+(?=\p{Script=Thai})|(?<=\p{Script=Lao})[ \t\r\n]+(?=\p{Script=Lao}))"
)
_LOWER_AHEAD = regex.compile(r"[^\p{SB=LE}\p{SB=UP}\p{SB=LO}\p{SB=NU}\p{SB=ST}\p{SB=AT}]*\p{SB=LO}")
_NEXT = regex.compile(r"[^\p{L}\p{N}\p{SB=ST}\p{SB=AT}]*([\p{L}\p{N}][\p{L}\p{M}]*)(.?)", regex.DOTALL)
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}.\-’']+")
_TOKEN = regex.compile(r"[^ \t\r\n]+")
_IGNORED = regex.compile(r"[\p{SB=EX}\p{SB=FO}]")
_UPPER = regex.compile(r"\p{Lu}")
_CLOSE = frozenset("\"'”’»›)]}」』》〉】）］｣〟")
_EITHER = frozenset("“‘\"'")
_OPEN = frozenset("“„«‹(\"'‘「『《〈【（｢[")
_CONTINUE = frozenset(",-:;–—、，：；﹐﹑﹔﹕､")
_NESTED = {"《": "》", "〈": "〉", "「": "」", "『": "』", "（": "）", "【": "】", "(": ")"}
_BRACKETS = regex.compile("[" + "".join(regex.escape(x) for kv in _NESTED.items() for x in kv) + r"]|\n[ \t\r]*\n|\u2029")
_WORD = regex.compile(r"\p{L}+")
_LETTER = regex.compile(r"\p{L}")
_SCRIPTS = {k: regex.compile(rf"(?V1)[\p{{L}}&&{v}]") for k, v in (("ru", r"\p{Cyrillic}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"), ("lo", r"\p{Lao}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"))}


def language(text: str, lang: str | None) -> str:
    """The given language, else one told by the scripts of its letters and by frequent words, over the whole text."""
    if lang:
        return lang
    letters = sum(1 for _ in _LETTER.finditer(text))
    for name, script in _SCRIPTS.items():
        if sum(1 for _ in script.finditer(text)) * 4 > letters:
            return name
    words = _WORD.findall(text.lower())
    score = {k: sum(w in v for w in words) for k, v in _HINTS.items()}
    best = max(score, key=score.get)
    return best if score[best] else ""


class _Text:
    """A text with the places that several rules ask for, each found once in a pass over the whole of it."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        known = lang if lang in _END else ""
        self.ends, self.number, self.may = _END[known], _NUMBER[known], _MAY[known]
        self.starters = _STARTERS.get(lang, _STARTERS[""])
        self._held: dict[str, list[int]] = {}

    def _start(self, name: str, pattern: regex.Pattern, at: int) -> int:
        """Where the run of a pattern begins that ends at or behind a place."""
        if name not in self._held:
            self._held[name] = [m.start() for m in pattern.finditer(self.text)]
        i = bisect_right(self._held[name], at - 1)
        return self._held[name][i - 1] if i else 0

    def inside(self, start: int, at: int) -> bool:
        """Is a place within brackets that were opened in this sentence and are closed in the same paragraph?"""
        if "opened" not in self._held:
            opened, closed, stacks = [], [], {x: [] for x in _NESTED.values()}
            for m in _BRACKETS.finditer(self.text):
                c = m.group()
                if c in _NESTED:
                    stacks[_NESTED[c]].append(m.start())
                elif c in stacks:
                    if stacks[c]:
                        opened.append(stacks[c].pop())
                        closed.append(m.start())
                else:
                    for x in stacks.values():
                        x.clear()
            order = sorted(range(len(opened)), key=lambda i: opened[i])
            self._held["opened"] = [opened[i] for i in order]
            # the last place that any bracket opened so far is closed at
            self._held["closed"] = np.maximum.accumulate([closed[i] for i in order]).tolist() if order else []
        i = bisect_right(self._held["opened"], at - 1)
        return bool(i) and self._held["closed"][i - 1] >= at and self._held["opened"][i - 1] >= start

    def opens(self, k: int) -> tuple[str, bool]:
        """The first letter or figure from a place on, and whether its word opens sentences."""
        m = _NEXT.match(self.text, k)
        if not m:
            return "", False
        word = m.group(1)
        initial = len(word) == 1 and m.group(2) == "."
        return word[0], not initial and word.lower() in self.starters

    def abbreviation(self, start: int, a: int, number: bool, opens: bool) -> bool:
        """Does the full stop at `a` belong to an abbreviation, an initial or an ordinal?"""
        text = self.text
        s = max(start, self._start("run", _RUN, a))
        if a - s <= _LONGEST:
            word = text[s:a]
            if word in self.ends or number and word in self.number:
                return True
            if word in self.may:
                return not opens
        if s < a and _UPPER.match(text[a - 1]) and (a - 1 == s or text[a - 2] in ".-‐" and a - 2 > s and _UPPER.match(text[a - 3])):
            return not opens
        if self.lang == "de" and 0 < a - s <= 2 and text[s:a].isdecimal():
            return not opens
        return False

    def address(self, start: int, a: int) -> bool:
        """Is the full stop at `a` part of an address or of a word with full stops, seen from the white space before it?"""
        s = max(start, self._start("token", _TOKEN, a))
        text = self.text
        return text.find("/", s, a) >= 0 or not text[a - 1].isdigit() and text.find(".", s, a) >= 0


def _ends(held: _Text, start: int, a: int, b: int) -> int:
    """The end of the sentence whose terminators are text[a:b], or -1 if it goes on."""
    text = held.text
    n, c = len(text), b
    last = text[b - 1]
    full_stop = last in ".․﹒．"
    # SB5, SB9: what closes, and what is ignored
    while c < n and (text[c] in _CLOSE or text[c] in _EITHER or ord(text[c]) > 767 and _IGNORED.match(text[c])):
        if text[c] in _EITHER and c + 1 < n and (text[c + 1].isalnum() or text[c + 1] in "¿¡") and text[c] != "’":
            break
        c += 1
    k = c
    # SB10
    while k < n and text[k] in " \u00a0\u202f\u2009\t\r\n":
        k += 1
    if k < n and k > c and text[k] in "»›" and "\n\n" not in text[c:k]:
        c = k = k + 1
        while k < n and text[k] in " \u00a0\u202f\u2009\t\r\n":
            k += 1
    closed = c > b
    if k >= n:
        return c
    gap, after = k > c, text[k]
    # SB8a
    if after in _CONTINUE:
        return -1
    if held.inside(start, c):
        return -1
    first, opens = held.opens(k)
    cased = first.lower() != first.upper()
    if not gap:
        # SB6, SB7
        if full_stop or last in "!?":
            if not first or not (first.isupper() or not cased and not first.isdigit()):
                return -1
            if full_stop:
                if a <= start or not (text[a - 1].islower() or text[a - 1].isdigit() or text[a - 1] in ")”»") or text[a - 1].isdigit() and not first.isupper():
                    return -1
                if held.address(start, a) or held.abbreviation(start, a, first.isdigit(), opens):
                    return -1
            return c
    elif full_stop:
        # SB8
        if b - a == 1 or closed:
            if _LOWER_AHEAD.match(text, k):
                return -1
        elif cased and first.islower():
            return -1
        if b - a == 1 and not closed and held.abbreviation(start, a, first.isdigit(), opens):
            return -1
    if closed and cased and first.islower():
        return -1
    if closed and not cased and first and not first.isdigit():
        # no case to tell: a quote that opened the sentence goes on with who said it
        if text[start] in _OPEN or after in "と" or text.startswith("って", k):
            return -1
    # SB11
    return c


def spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Start and end of every sentence, in code points."""
    if not text:
        return []
    held = _Text(text, language(text, lang))
    out, n = [], len(text)

    def skip(i: int) -> int:
        while i < n and text[i] in WHITE:
            i += 1
        return i

    start = skip(0)
    for m in _PLACE.finditer(text):
        a, b = m.span()
        if b <= start:
            continue
        kind = m.lastgroup
        if kind == "end":
            end = _ends(held, start, a, b)
            if end < 0:
                continue
        elif kind == "blank":
            end = a
        else:
            if not (" " in text[a:b] or "\t" in text[a:b]):
                continue
            end = a
        if end > start:
            out.append((start, end))
        start = skip(max(end, b))
    if start < n:
        end = n
        while text[end - 1] in WHITE:
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def sentences(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, sent_start, sent_end), one row a sentence of each row's text."""

    def run(batch: pa.RecordBatch):
        ids, places = [], []
        for item, value, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = spans(value, code)
            ids.append(np.full(len(found), item, np.int64))
            places.extend(found)
        if places:
            both = np.array(places, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[key, "sent_start", "sent_end"])

    return arrow_map(docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("bigint").alias(key), text, lang), run, f"{key} bigint, sent_start int, sent_end int")


def found(pages: DataFrame) -> DataFrame:
    """p3_found: the sentences of every counted page."""
    return sentences(counted_pages(pages, "content", "lang"), "page_id", "content", "lang")
