"""Regular expressions in Java syntax that mean what the usual Unicode classes mean.

Fixed values: the patterns must match exactly what the rules of the format say.
"""

#: A letter, digit or underscore, in and out of brackets.
W = r"[\p{L}\p{N}_]"
#: White space, the four separators 1C-1F included; needs the U flag around it.
SP = r"(?U:[\s\x1c-\x1f])"
#: A place between a word character and none.
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

#: The characters of white space.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

TAG = r"<[^>]+>"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Where a match may begin is looked at first, here and below: the costlier parts then run at few places.
FOOTNOTE = rf"""(?=[\[(¹²³⁰-⁹]|{SP})(?<=[a-zA-Z.,!?"']){SP}*(?:\[\p{{Nd}}{{1,3}}\]|\(\p{{Nd}}{{1,3}}\)|[¹²³⁰-⁹]+)(?={SP}|\z|\n\z)"""
SPLIT_WORD = rf"({W})-\n({W})"
DASH = rf"(?:{SP}++[–—]|[–—]){SP}*"
TABLE_LINE = r"(?d)\|.*\|"
SPACE_BEFORE_MARK = rf"{SP}+([.,!?;:])"
FOREIGN = r"[^\x00-\x7F]{4,}"

CURRENCY = rf"[$£€]{SP}?[0-9][0-9,]*(?:\.[0-9]+)?"
# The digit that must come is looked for first: the costlier look-behind then runs at few places.
_START, _END = rf"(?=[0-9])(?<!{W})", rf"(?!{W})"
DECIMAL = rf"{_START}[0-9]+\.[0-9]+{_END}"
ORDINAL = rf"{_START}[0-9]+(?i:st|nd|rd|th){_END}"
YEAR = rf"{_START}(?:1[0-9]{{3}}|20[0-9]{{2}}){_END}"
PLAIN = r"(?=[0-9])(?<![\p{L}\p{N}_.])[0-9]{1,9}(?![\p{L}\p{N}_.])"
# All of them in one search. Amounts come first in the order of rules: to the others, one that follows is a word already.
NUMBER = rf"(?=[0-9$£€])(?:{CURRENCY}|(?:{DECIMAL}|{ORDINAL}|{YEAR}|{PLAIN})(?!{CURRENCY}))"

SPINE_SKIP = r"(?i)(cover|titlepage|title-page|toc|nav|copyright|colophon|dedication|pg-header|pg-footer|wrap0000)"
CONTENTS_TITLE = r"(?i)^((table of )?contents( in detail)?|index)\n?\z"
BARE_NUMBER = r"(?i)^([0-9]{1,3}|[IVXLCDM]{1,7})\.?\n?\z"
BARE_CHAPTER = rf"(?i)^chapter{SP}+([0-9]{{1,3}}|[IVXLCDM]{{1,7}})\.?\n?\z"
FILE_CHAPTER = rf"(?i){EDGE}ch(?:a?p?ter)?(?:{SP}|[_-])?[0-9]{{1,3}}{EDGE}"
HEADING_LINE = rf"(?id)^{SP}*(?:(?:chapter|part){SP}+(?:[0-9]{{1,3}}|[ivxlcdm]{{1,7}}){EDGE}[:.\-–—]?{SP}{{0,3}}.{{0,40}}|(?:chapter|part){SP}+{W}+{SP}*:{SP}*.{{0,40}}|(?:prologue|epilogue|introduction|preface|afterword){SP}*)$"
