"""Words of names across scripts: look-alikes resolved, accents dropped, other alphabets written in Latin letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from vitrine.functions.text import ONE_LETTER, TWO_LETTERS
from vitrine.llm.confusables import LOOKALIKES, skeleton

# Letters of other alphabets and their usual Latin spelling.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґѕј", "a b v g d e zh z i j k l m n o p r s t u f h c ch sh sch _ y _ e yu ya e i i e g s j".replace("_", "").split(" ")))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n j o p r s s t u f h ps w".split()))

_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
#: ASCII letters in lower case; what is no letter or digit parts words.
_PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_RUN = regex.compile(r"[\p{Katakana}\p{Hiragana}ー]+|\p{Han}+|[^\p{Katakana}\p{Hiragana}\p{Han}ー]+")
_KANA = regex.compile(r"[\p{Katakana}\p{Hiragana}]")
_BACK: dict[str, dict[str, str]] = {"CYRILLIC": {}, "GREEK": {}}
for _pair in LOOKALIKES.split():
    _name = unicodedata.name(_pair[0], "").split()[0]
    if _name in _BACK and _pair[0].lower() in (CYRILLIC if _name == "CYRILLIC" else GREEK):
        _BACK[_name].setdefault(_pair[1].lower(), _pair[0].lower())
_LIKE = {s: {v for v in b.values()} for s, b in _BACK.items()}


def _kana(run: str) -> str:
    """Latin spelling of kana, told by the letters' Unicode names: small vowels replace the vowel before them."""
    out = ""
    for ch in unicodedata.normalize("NFC", run):
        parts = unicodedata.name(ch, "").split()
        if "LETTER" not in parts:
            continue
        small, sound = "SMALL" in parts, parts[-1].lower()
        if sound == "n":
            out += "n"
        elif small and sound == "tu":
            continue
        elif small and out:
            vowel = sound[-1]
            head = out[:-1]
            if out.endswith("ru"):
                head = out[:-2] + "l"
            elif out[-1] == "u" and (len(out) < 2 or out[-2] in "aeioun"):
                head = out[:-1] + "w"
            out = head + vowel
        else:
            out += {"zi": "ji", "vu": "vu"}.get(sound, sound)
    return out


@lru_cache(200_000)
def _word(word: str) -> tuple[str, ...]:
    """Latin words of one run of letters and digits."""
    low = word.lower()
    if word.isascii():
        return (low,)
    scripts = {}
    for ch in low:
        name = unicodedata.name(ch, "").split(" ", 1)[0]
        if name in ("LATIN", "CYRILLIC", "GREEK"):
            scripts.setdefault(name, set()).add(ch)
    for script, table in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK)):
        if script in scripts:
            own = {unicodedata.normalize("NFD", c)[0] for c in scripts[script]}
            if "LATIN" not in scripts or own - _LIKE[script]:
                base = "".join(_BACK[script].get(c, c) for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
                return (unicodedata.normalize("NFC", "".join(table.get(c, c) for c in base)),)
    text = skeleton(word).lower() if len(scripts) > 1 else low
    out = []
    for run in _RUN.findall(text):
        if _KANA.search(run):
            out.append(_kana(run))
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", run) if not unicodedata.combining(c))
        for a, b in (*ONE_LETTER.items(), *TWO_LETTERS.items()):
            if a in plain:
                plain = plain.replace(a, b)
        out.append(plain)
    return tuple(x for x in out if x)


_NARROW = regex.compile(r"[\p{Cf}\p{Mn}--[̀-゙゚ͯ]]", regex.V1)


def _bare(word: str) -> str:
    """A German adjective made from a name counts as the name."""
    return word[:-5] if len(word) > 11 and word.endswith("sches") else word


def words(text: str | None) -> list[str]:
    """Latin words of a name in their order; none for a null or blank one."""
    if not text:
        return []
    if text.isascii():
        low = text.translate(_PLAIN)
        return [_bare(w) for w in low.split()] if "sches" in low else low.split()
    flat = unicodedata.normalize("NFKC", _NARROW.sub("", text))
    return [_bare(w) for run in _WORD.findall(flat.replace("’", " ").replace("'", " ")) for w in _word(run)]
