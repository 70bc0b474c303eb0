"""Sentence boundaries across languages and scripts.

A text is cut into blocks (blank lines) and list items first. Inside a block every terminator, and every gap
between letters of a script without spaces, is a node of a lattice whose edges are the spans between nodes;
quotation and bracket spans close edges, and whether an edge ends at a node is decided from the token before it,
the closing marks and what follows:

- spaced scripts: abbreviations, initials, ordinals, decimals and ellipses, and the case of the next word;
- scripts without spaces (Thai, Lao, Khmer, Burmese, Chinese, Japanese): full stops end a sentence. The stretches
  beside a gap without a stop, and what follows a quotation, are segmented by a lattice of dictionary words, and the
  words at the gap classify it: final particles before it, opening words after it, words that tie.

The dictionary is the fixed words below and the words that a public vocabulary file holds for these scripts
(``dictionary``). The text's own characters decide, never its language label. Each stretch, token and clause is
looked at once, so the work grows with the text whatever it holds.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations that a name, number or noun follows; they never end a sentence.
NEVER_LAST = frozenset(
    "dr prof mr mrs ms messrs rev capt lt col gen sgt maj hon pres gov sen rep st ste sta sto ss mt ft "
    "sr sra srta dra sres sras sig sigg dott dottssa avv ing arch mme mmes mlle mm hr hrn fr frl fa dipl "
    "vgl bzw insg ca approx aprox env circa ok tägl ggf evtl sog inkl exkl zzgl bspw z u f "
    "cf viz vs eg ie al inv fig figs eq sec chap cap ch cat vol vols bd bde bde nr no nos núm num n p pp pág págs pag pagg s "
    "см проф акад доц им ул св стр рис ср напр κ κα καθ αρ σελ βλ π.χ δρ "
    "د أ ص ج رقم डॉ श्री प्रो सं".split()
)
# Abbreviations that may stand last; a capital after them begins a sentence.
MAYBE_LAST = frozenset(
    "etc am pm us uk usa eu bc ad jr ltd co inc corp bros dept est ave blvd rd usw ff ev h min sec kg km cm "
    "ecc segg ss suiv jh jhd jan feb mar apr jun jul aug sep sept oct nov dec mai okt dez janv févr juil déc genn febbr sett ott nov dic ene abr ago "
    "г гг в вв др пр т д тыс млн руб коп μ μμ πμ κλπ μχ".split()
)
# Abbreviations that a number follows, and that otherwise may stand last.
BEFORE_NUMBER = frozenset("no nos nr núm num n c ca approx aprox env p pp pág págs s bd vol vols fig art abs kap ch cap inv cat tel jan feb mar apr jun jul aug sep sept oct nov dec т с ок г стр гл № αρ σελ".split())
# What an ordinal with a point stands before, or after.
ORDINAL_NEXT = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jh stock etage obergeschoss untergeschoss bezirk auflage klasse platz mal juni jänner kapitel band teil januari".split())
ORDINAL_PREV = frozenset("am im ins dem den der die das vom zum zur beim des bis seit ab".split())
# Words of saying that tie a quotation to what follows it, where case can't tell.
SAYING = ("说", "说道", "問", "问", "问道", "写道", "回答", "喊", "表示", "道", "と", "って", "قال", "قالت", "سأل", "कहा", "पूछा", "बोले", "बोला", "बोली", "लिखा")
# Words that open a sentence in scripts without spaces (pronouns, question words, conjunctions, modals).
OPENING = (
    "เขา เธอ เรา ฉัน ผม พวกเขา มัน ท่าน คุณ ทุกคน ใคร ทำไม เมื่อ อะไร ที่ไหน อย่างไร กรุณา โปรด นี่ นั่น วันนี้ พรุ่งนี้ ไม่มี ไม่ สามารถ มี เป็น ดังนั้น อย่างไรก็ตาม นอกจากนี้ หลังจาก ก่อน ถ้า หาก "
    "ຂ້ອຍ ເຂົາ ລາວ ພວກເຮົາ ນີ້ ຖ້າ ខ្ញុំ គាត់ នាង យើង នេះ ប្រសិនបើ ကျွန်တော် သူ ဤ ထို "
    "我 我们 我們 你 他 她 它 他们 他們 这 這 那 这个 這個 因此 所以 但是 然而 不过 不過 如果 今天 "
    "しかし そして また この その あの これ それ ここ 私 彼 彼女 なお ただし さらに もし だから"
).split()
# Words that tie what stands on either side of a gap.
TIED = (
    "พ.ศ. ค.ศ. โดย และ หรือ ที่ ซึ่ง อัน ของ ใน จาก ถึง กับ เพื่อ แต่ แก่ ให้ ด้วย ตาม ต่อ สำหรับ ว่า จน จนถึง ระหว่าง เมตร บาท ปี คน ชิ้น แผ่น องศา กิโลเมตร เล่ม หน้า นาฬิกา น. วัน เดือน เปอร์เซ็นต์ ครั้ง ชั้น ประมาณ เท่านั้น "
    "ແລະ ຫຼື ທີ່ ຂອງ ໃນ និង ឬ ដែល របស់ ក្នុង နှင့် သို့မဟုတ် "
    "的 和 与 與 或 在 是 と って が は を に の も や へ で けど から ので"
).split()
# Particles and endings that close a sentence.
FINAL = (
    "ครับ ค่ะ คะ นะ จ้ะ สิ ล่ะ แล้ว เลย ไหม หรือไม่ หรือเปล่า ແລ້ວ ບໍ ເດີ ហើយ ទេ ណា ပါတယ် တယ် သည် ပြီ ပါသည် "
    "了 吗 嗎 呢 吧 啊 です ます でした ました ません だった である ください だろう でしょう ですか ますか ね よ"
).split()
# Other frequent words, so that the lattice finds the ends of its words.
OTHER = "อายุ เข้า ยัง ทุก นี้ ขึ้น ได้ ไป มา อยู่ คือ การ ความ ນີ້ ໄດ້ បាន នៅ នេះ များ သော ある いる する した して ない こと もの 有 不 也 都 就 很".split()

_ENDS = ".!?…。！？｡؟۔।॥‼⁇⁈⁉;;"
_TERMINATOR = regex.compile(r"[.!?…。！？｡؟۔।॥‼⁇⁈⁉]+|(?<=\p{Greek}[»\")]?)[;;]")
_BLANK = regex.compile(r"(?:\r\n|\r|\n| | |\x0b|\x0c)[^\S\r\n]*(?:\r\n|\r|\n| )\s*| \s*")
_MARKER = regex.compile(r"[^\S\r\n]*(?:([-–•*·▪◦‣●○])|(\d{1,3})[.)．]|([a-zA-Z])\))[^\S\r\n]+(?=\S)")
_LINE = regex.compile(r"\r\n|\r|\n| ")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}][\p{L}\p{M}\p{Nd}.’'\-]*|№")
_OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "‹": "›", "„": "“”", "(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "《": "》"}
_BRACKETS = "(（[［"
_SPANS = regex.compile(r"[“”«»「」『』‹›„()（）\[\]［］【】《》]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CASELESS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Hebrew}\p{Bengali}\p{Tamil}\p{Telugu}\p{Gujarati}\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
_SPACED = regex.compile(r"[\s\S]*[\p{Arabic}\p{Devanagari}]")
_SPACELESS = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Han}\p{Hiragana}\p{Katakana}ー"
_LOOSE = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_GAP = regex.compile(r"(?<=\S)\s+(?=\S)")
_ANY = regex.compile(rf"[{_SPACELESS}]")
_STRETCH = regex.compile(r"\S+")
_RUN = regex.compile(rf"[{_SPACELESS}\p{{M}}]+")
_PART = regex.compile(rf"[{_SPACELESS}\p{{M}}.]+")


class Lattice:
    """Segmentation of stretches without spaces by the best path through dictionary words.

    Best is the path with the fewest characters outside words, then with the fewest words.
    """

    def __init__(self, words: frozenset[str]):
        self.words, self.longest = words, max(map(len, words))

    def cut(self, s: str) -> list[str]:
        n = len(s)
        cost = [(0, 0)] + [(n + 1, 0)] * n
        back = [0] * (n + 1)
        for i in range(n):
            c, w = cost[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                known = s[i:j] in self.words
                if not known and j > i + 1:
                    continue
                new = (c + (0 if known else 1), w + 1)
                if new < cost[j]:
                    cost[j], back[j] = new, i
        out, j = [], n
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]


def dictionary(vocabulary: str | None = None) -> frozenset[str]:
    """The fixed words and, if a vocabulary file is given, its words of two letters or more in scripts without spaces.

    The file has a base64 token and its rank on each line.
    """
    words = {*OPENING, *TIED, *FINAL, *OTHER, *SAYING}
    for line in Path(vocabulary).read_bytes().splitlines() if vocabulary else ():
        try:
            word = base64.b64decode(line.split()[0]).decode().strip()
        except (ValueError, IndexError):
            continue
        if len(word) > 1 and _RUN.fullmatch(word) and not regex.match(r"\p{M}", word):
            words.add(word)
    return frozenset(words)


_OPENING, _TIED, _FINAL, _SAYING = frozenset(OPENING), frozenset(TIED), frozenset(FINAL), frozenset(SAYING)
_FIXED = Lattice(dictionary())


def _spans(s: str) -> list[tuple[int, int, str]]:
    """Matched quotations and brackets as (opening position, closing position, opening mark), nested, by position."""
    out, stack = [], []
    waiting: dict[str, int] = {}  # how many open marks wait for a closing mark
    for m in _SPANS.finditer(s):
        ch, i = m.group(), m.start()
        if ch in _OPEN and not (ch == "“" and waiting.get("“")):
            stack.append((ch, i))
            for c in _OPEN[ch]:
                waiting[c] = waiting.get(c, 0) + 1
            continue
        while waiting.get(ch):
            o, at = stack.pop()
            for c in _OPEN[o]:
                waiting[c] -= 1
            if ch in _OPEN[o]:
                out.append((at, i, o))
                break
    return sorted(out)


class _Stretches:
    """Lattice words at the gaps of a text, each stretch between blanks segmented once."""

    def __init__(self, s: str, lattice: Lattice):
        self.s, self.lattice = s, lattice
        self.starts = [m.start() for m in _STRETCH.finditer(s)]
        self.known: dict[int, list[str]] = {}

    def at(self, i: int) -> tuple[str, list[str]]:
        """The stretch that holds position i, and its words; what isn't of a spaceless script is one word."""
        a = self.starts[bisect_right(self.starts, i) - 1]
        if a not in self.known:
            text = _STRETCH.match(self.s, a).group()
            words, at = [], 0
            for m in _PART.finditer(text):
                if m.start() > at:
                    words.append(text[at : m.start()])
                words += self.lattice.cut(m.group())
                at = m.end()
            if at < len(text):
                words.append(text[at:])
            self.known = {a: (text, words)}  # the next gap asks for this stretch or the one behind it
        return self.known[a]


def _gap_breaks(stretches: _Stretches, a: int, b: int) -> bool:
    """Whether the gap s[a:b] in a script without spaces parts two sentences."""
    left, lws = stretches.at(a - 1)
    right, rws = stretches.at(b)
    lw, rw = lws[-1], rws[0]
    if left.endswith(".") or left[-1] in ",:;–—-(“\"«、，：；（「『":
        return False
    if _LOOSE.match(left[-1]) or _LOOSE.match(right):
        if rw in _OPENING:
            return lw not in ("ของ", "ใน", "ที่", "โดย", "และ", "หรือ", "กับ")
        if rw in _TIED or not _LOOSE.match(right):
            return False
        return lw in _FINAL or not left[-1:].isdigit()
    # Chinese and Japanese: a blank parts sentences only behind a word that closes one
    closed = lw in _FINAL and len(left) > len(lw) and rw not in _TIED
    return closed and ("\n" not in stretches.s[a:b] and "\r" not in stretches.s[a:b] or rw in _OPENING)


class _Tokens:
    """Token before a position: letters, digits and the points between them, each run found once."""

    def __init__(self, s: str):
        self.s = s
        spans = [m.span() for m in _TOKEN.finditer(s)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def before(self, i: int) -> str:
        k = bisect_left(self.starts, i) - 1
        return self.s[self.starts[k] : i] if k >= 0 and self.ends[k] >= i else ""


def _ends(s: str, tokens: _Tokens, lattice: Lattice, begin: int, a: int, b: int, stop: int, quoted: tuple[int, int, str] | None, raw_next: int) -> bool:
    """Whether the terminator s[a:b], with closing marks up to ``stop``, ends the sentence that began at ``begin``."""
    run = s[a:b]
    nxt = s[raw_next] if raw_next < len(s) else ""
    if not nxt:
        return True
    gap = raw_next > stop
    cjk_end = run[-1] in "。！？｡" or (run[-1] in "!?" and (_CJK.match(s[a - 1]) if a else None))
    if run[0] in "…" or run.startswith("..") or run.startswith("。。"):
        only_dots = all(c in "….。" for c in run)
        if only_dots:
            if not gap or _CJK.match(nxt):
                return False
            return nxt.isupper() or nxt in "¿¡«“„「(" or bool(_CASELESS.match(nxt) and not _CJK.match(nxt))
    if quoted:
        if nxt in ",;:،、，；—–-" or nxt.islower():
            return False
        lead = s[max(begin, quoted[0] - 1) : quoted[0]].rstrip() or s[begin : quoted[0]].rstrip()[-1:]
        caseless = _CASELESS.match(nxt)
        if caseless:
            if nxt in "とっ" and s.startswith(("と", "って"), raw_next):
                return False
            if lead and lead[-1] in ":：,，、":
                return True
            m = _TERMINATOR.search(s, raw_next)
            clause = s[raw_next : m.start() if m else len(s)]
            if _SPACED.match(clause):
                return not any(w in clause for w in SAYING)
            # a verb of saying in the clause behind it ties the quotation
            return not any(w in _SAYING or any(w.endswith(v) for v in _SAYING if len(v) > 1) for run in _RUN.findall(clause) for w in lattice.cut(run))
        return True
    if cjk_end:
        return True
    if run[-1] in "!?؟۔।॥‼⁇⁈⁉;;":
        if nxt in ",;:،、，—–" or nxt.islower():
            return False
        return gap or nxt.isupper() or bool(_CASELESS.match(nxt)) or nxt in "«“„¿¡("
    # a single point
    token = tokens.before(a)
    if not gap:
        # a missing blank: a whole lower-case word before, a capitalised word or an opening mark after
        word = token.rsplit(".", 1)[-1]
        after = s[raw_next + 1] if raw_next + 1 < len(s) else ""
        if nxt in "«“„¿¡":
            return len(word) > 1 or word.isdigit()
        if token[:4].lower() in ("www.", "http") and "." in token[:-1]:
            return False
        return (len(word) > 2 and word[-1].islower() and nxt.isupper() and (after.islower() or after in " .’'")) or (word.isdigit() and len(word) >= 3 and nxt.isupper() and after.islower()) or (
            stop > b and nxt.isupper()) or (nxt.isupper() and s[a - 1 : a] in ")%€$£»”“")
    if nxt in ",;:،、，—–" or nxt.islower():
        return False
    low = token.lower()
    bare = low.replace(".", "").replace("-", "")
    last = low.rsplit(".", 1)[-1].rsplit("-", 1)[-1]
    if _CASELESS.match(nxt) or (token and _CASELESS.match(token[-1])):
        if token and _CASELESS.match(token[-1]):
            if bare in NEVER_LAST or token in ("م",) or (token[-1] == "م" and token[:-1].isdigit()) or token == "พ.ศ":
                return False
        return True
    if nxt.isdigit():
        if bare in BEFORE_NUMBER or bare in NEVER_LAST or last in BEFORE_NUMBER:
            return False
        return not (len(token) == 1 and token.isalpha())
    if not token:
        return True
    if bare.isdigit():
        if len(bare) <= 2 and "." not in token:
            word = regex.match(r"[\p{L}\p{M}]+", s, pos=raw_next)
            prev = regex.search(r"([\p{L}]+)\s+\d{1,2}$", s[max(0, a - 30) : a])
            if (word and word.group().lower() in ORDINAL_NEXT) or (prev and prev.group(1).lower() in ORDINAL_PREV and not (word and word.group().lower() in ("der", "die", "das"))):
                return False
        return True
    if bare == "v" and regex.search(r"\be\.\s?V$", s[max(0, a - 8) : a]):
        return True
    if bare == "b" and regex.search(r"\bz\.\s?B$", s[max(0, a - 8) : a]):
        return False
    if len(token) == 1 and token.isalpha():
        if token.isupper():
            return bool(regex.search(r"[°º]\s?[NSEWO]$", s[max(0, a - 4) : a]))
        if regex.search(r"\b[udis]\.\s?[aädURh]$", s[max(0, a - 6) : a]) or token not in "hmglгдтвпμм":
            return False
        return True
    if "." in token and all(len(p) == 1 for p in token.split(".")):
        return bare in MAYBE_LAST or token.isupper() or bare.isupper()
    if bare in MAYBE_LAST or last in MAYBE_LAST:
        return True
    if bare in NEVER_LAST or last in NEVER_LAST:
        return bare in ("no", "s", "al", "ch", "sec") and not s[raw_next].isdigit() and bare == "no"
    return True


def _segment(s: str, at: int, first: int, out: list[tuple[int, int]], lattice: Lattice = _FIXED) -> None:
    """Units of one stretch ``s`` that stands at offset ``at``; scanning starts at ``first`` (after a marker)."""
    spans = _spans(s)
    tokens = _Tokens(s)
    cuts: list[int] = []
    begin = 0
    while begin < len(s) and s[begin].isspace():
        begin += 1
    # spans are nested, so only those that no other holds decide
    widest: list[tuple[int, int, str]] = []
    for x in spans:
        if not widest or x[0] > widest[-1][1]:
            widest.append(x)
    opened, opening = [x[0] for x in widest], {x[0]: x for x in spans}

    def outer(i: int) -> tuple[int, int, str] | None:
        k = bisect_left(opened, i) - 1
        return widest[k] if k >= 0 and i < widest[k][1] else None

    nodes = [(m.start(), m.end(), 0) for m in _TERMINATOR.finditer(s, first)]
    if _ANY.search(s):
        stretches = _Stretches(s, lattice)
        nodes += [(m.start(), m.end(), 1) for m in _GAP.finditer(s, first) if _ANY.match(s[m.start() - 1]) or _ANY.match(s[m.end()])]
        nodes.sort()
    closing = {x[1] for x in spans}

    def closers(i: int) -> int:
        """Position after the closing marks that stand at i; French ones may follow a blank."""
        while i < len(s):
            k = i
            while k < len(s) and s[k].isspace():
                k += 1
            if k in closing and (k == i or s[k] in "»›"):
                i = k + 1
            elif s[i] in "\"’'" and (i + 1 == len(s) or not s[i + 1].isalnum()):
                i += 1
            else:
                break
        return i

    limit = first
    for a, b, kind in nodes:
        if a < limit:
            continue
        if kind:
            if not a or s[a - 1] in _ENDS or outer(a):
                continue
            if _gap_breaks(stretches, a, b):
                cuts.append(a)
                begin = limit = b
            continue
        around = outer(a)
        stop, quoted = b, None
        reach = closers(b)
        if around:
            if reach <= around[1]:
                continue  # inside a quotation or bracket that goes on
            stop = reach
            if around[2] in _BRACKETS:
                if around[0] > begin and not s[begin : around[0]].isspace():
                    continue  # a bracket inside a sentence
            else:
                quoted = around
        else:
            stop = reach
        raw = stop
        while raw < len(s) and s[raw].isspace():
            raw += 1
        if raw < len(s) and s[raw] in _BRACKETS and not quoted:
            # a bracketed sentence begins here only if its own stop stands before its closing mark
            x = opening.get(raw)
            inner = s[raw + 1 : x[1]].rstrip() if x else ""
            if inner and inner[-1] in _ENDS and (inner[0].isupper() or _CASELESS.match(inner[0]) or inner[0] in "¿¡«“„"):
                if _ends(s, tokens, lattice, begin, a, b, stop, quoted, raw + 1):
                    cuts.append(stop)
                    begin, limit = raw, stop
                continue
            if s[a:b] in (".",) and tokens.before(a).lower().replace(".", "") in (NEVER_LAST | MAYBE_LAST):
                continue
            if inner and (inner[0].islower() or inner[0].isdigit()):
                continue
        nraw = raw
        if nraw < len(s) and s[nraw] in "«“„「『‹\"'‘¿¡(":
            k = nraw
            while k < len(s) and (s[k] in "«“„「『‹\"'‘¿¡(" or s[k].isspace()):
                k += 1
            probe = k
        else:
            probe = nraw
        if probe != nraw and probe < len(s):
            # an opening mark: what it opens decides by its case, the gap stays as it is
            ok = _ends(s, tokens, lattice, begin, a, b, stop if raw > stop else min(stop, probe - 1), quoted, probe)
        else:
            ok = _ends(s, tokens, lattice, begin, a, b, stop, quoted, raw)
        if ok:
            cuts.append(stop)
            begin = limit = raw
    prev = 0
    for c in [*cuts, len(s)]:
        x, y = prev, c
        while x < y and s[x].isspace():
            x += 1
        while y > x and s[y - 1].isspace():
            y -= 1
        if y > x:
            out.append((at + x, at + y))
        prev = c


def sentences(text: str | None, lattice: Lattice = _FIXED) -> list[tuple[int, int]]:
    """Sentence units as code-point offsets (end exclusive); null, empty and blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    begin = 0
    for a, b in [*(m.span() for m in _BLANK.finditer(text)), (len(text), len(text))]:
        block = text[begin:a]
        if block and not block.isspace():
            m = _MARKER.match(block)
            if m:
                kind = m.lastindex
                starts = [0] + [x.end() for x in _LINE.finditer(block) if (y := _MARKER.match(block, x.end())) and y.lastindex == kind]
                for i, j in zip(starts, [*starts[1:], len(block)]):
                    _segment(block[i:j], begin + i, _MARKER.match(block, i).end() - i, out, lattice)
            else:
                _segment(block, begin, 0, out, lattice)
        begin = b
    return out


def split_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of every document, in one pass without a shuffle.

    Rows with a null doc_id are left out; offsets are code points of the text as it is. ``vocabulary`` names the
    public vocabulary file whose words join the dictionary; it is read on the driver.
    """
    lattice = Lattice(dictionary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends, size = [], [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for x, y in sentences(t, lattice):
                    ids.append(i)
                    starts.append(x)
                    ends.append(y)
                size += len(t or "")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "sent_start", "sent_end"])
                    ids, starts, ends, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "sent_start", "sent_end"])

    return documents.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id bigint, sent_start int, sent_end int")
