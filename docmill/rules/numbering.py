"""Heading numbering as data: clean-up rules and schemes."""

from __future__ import annotations

# Character classes and patterns of the clean-up rules, in order of use; and the schemes' templates.
_SPACE = r"[\s\u3000\u00A0\u200B\uFEFF]"
_SEP = r"[\.．、，,。]"
_NUM_CN = "一二三四五六七八九十百千壹贰叁肆伍陆柒捌玖拾佰仟零㈠㈡㈢㈣㈤㈥㈦㈧㈨㈩"
_NUM = rf"[{_NUM_CN}0-9０-９]"
CHINESE_NUMS = "一二三四五六七八九十百千零"
CIRCLED_1_50 = "①-⑳㉑-㉟㊱-㊿"
_CIRCLED = rf"[{CIRCLED_1_50}⓪⓵-⓾⓿❶-❿⓫-⓴㈠-㈩]"
CLEAN_RULES = {
    "chinese_unit_suffix": rf"^{_SPACE}*第{_SPACE}*{_NUM}+{_SPACE}*[回篇册卷部集期编章节条款项目]{_SPACE}+",
    "chinese_unit_prefix": rf"^{_SPACE}*[卷篇册部集期编章节回]{_SPACE}*{_NUM}+{_SPACE}+",
    "circled_numbers": rf"^{_SPACE}*{_CIRCLED}{_SEP}?{_SPACE}*",
    "bracket_number": rf"^{_SPACE}*[（(]?{_NUM}+[)）]{_SEP}?{_SPACE}*",
    "hierarchical": rf"^{_SPACE}*[0-9０-９]+(?:\.[0-9０-９]+)+{_SEP}?{_SPACE}+",
    "number_separator": rf"^{_SPACE}*{_NUM}+{_SEP}{_SPACE}*",
}
#: Off unless named.
MORE_RULES = {
    "legal_english": rf"^{_SPACE}*(?:Chapter|Part|Volume|Book|Section)\s+[0-9IVXLCDMivxlcdm]+[\s\.:\-]+",
    "letter_number": rf"^{_SPACE}*(?:[（(][a-zA-Z][)）]|[a-zA-Z][)）]|[a-zA-Z]{_SEP}){_SPACE}*",
}


def _dotted(level: int) -> str:
    return ".".join(f"{{{k}.arabic_half}}" for k in range(1, level + 1)) + " "


SCHEMES = {
    "gongwen_standard": {1: "{1.chinese_lower}、", 2: "（{2.chinese_lower}）", 3: "{3.arabic_half}. ", 4: "（{4.arabic_half}）", 5: "{5.arabic_circled}"} | {k: _dotted(k) for k in range(6, 10)},
    "hierarchical_standard": {k: _dotted(k) for k in range(1, 10)},
    "legal_standard": {1: "第{1.chinese_lower}编　", 2: "第{2.chinese_lower}章　", 3: "第{3.chinese_lower}节　", 4: "第{4.chinese_lower}条　", 5: "（{5.chinese_lower}）"} | {k: _dotted(k) for k in range(6, 10)},
}
