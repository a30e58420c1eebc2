"""RTF, after the public specification: groups, control words, escapes."""

from __future__ import annotations

import re

from .registry import Extraction, register

# Fixed values of the format: destinations whose content is no text, and control words that stand for characters.
DESTINATIONS = frozenset(
    "author bkmkend bkmkstart buptim category colortbl comment company creatim datastore doccomm docvar fldinst filetbl fonttbl footer footerf footerl footerr "
    "generator header headerf headerl headerr info keywords latentstyles listoverridetable listtable mmathPr nextfile objdata operator pgptbl pict printim private revtbl "
    "revtim rsidtbl shppict stylesheet subject themedata title txe ud upr userprops wgrffmtfilter xmlnstbl".split()
)
SPECIAL = {"par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "tab": "\t", "cell": "|", "row": "\n", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
TOKEN = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)


def to_text(rtf: str) -> str:
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, skip, width, page = False, 0, 1, "cp1252"
    for m in TOKEN.finditer(rtf):
        word, number, code, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((hidden, width))
        elif brace == "}":
            hidden, width = stack.pop() if stack else (False, 1)
            skip = 0
        elif symbol is not None:
            if symbol == "*":
                hidden = True
            elif not hidden and symbol in "{}\\":
                out.append(symbol)
            elif not hidden and symbol == "~":
                out.append("\u00a0")
            elif not hidden and symbol in "\r\n":
                out.append("\n")
        elif word is not None:
            skip = 0
            if word in DESTINATIONS:
                hidden = True
            elif word == "ansicpg" and number:
                page = f"cp{number}"
            elif word == "uc":
                width = int(number or 1)
            elif word == "u" and number:
                if not hidden:
                    out.append(chr(int(number) % 65536))
                skip = width
            elif not hidden and word in SPECIAL:
                out.append(SPECIAL[word])
        elif code is not None:
            if skip:
                skip -= 1
            elif not hidden:
                try:
                    out.append(bytes.fromhex(code).decode(page, errors="replace"))
                except LookupError:
                    out.append(bytes.fromhex(code).decode("cp1252", errors="replace"))
        elif char is not None:
            if skip:
                skip -= 1
            elif not hidden:
                out.append(char)
    # Pairs of surrogates, each from an escape of its own, become one character.
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", errors="replace")


@register(".rtf")
def read_rtf(raw: bytes, extension: str) -> Extraction:
    return Extraction(text=to_text(raw.decode("latin-1")), encoding="latin-1")
