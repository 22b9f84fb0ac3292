"""Word segmentation for queries and for the segmented column of indexes."""

from __future__ import annotations

import re
from typing import Protocol

# Characters and words that an index's match expressions keep for themselves.
RESERVED = """"'(){}[]*:^+-~"""
OPERATORS = ("and", "or", "not")
#: Kinds of ASCII characters, and between which of them, one after the other, a term is taken apart.
CLASSES = {"upper": "A-Z", "lower": "a-z", "digit": "0-9"}
BREAKS = (("lower", "upper"), ("digit", "upper"), ("lower", "digit"), ("upper", "digit"), ("digit", "lower"))

_BLANKED = str.maketrans(RESERVED, " " * len(RESERVED))
_APART = frozenset(BREAKS)
RUN = re.compile(r"[㐀-鿿]+|[^\W㐀-鿿]+|[^\w\s]")


def kind(c: str) -> str:
    if not c.isascii():
        return ""
    return "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else ""


def apart(text: str) -> str:
    """Blanks where a term's parts meet."""
    kinds = [kind(c) for c in text]
    return "".join(f" {c}" if pair in _APART else c for c, pair in zip(text, zip(["", *kinds], kinds, strict=False), strict=True))


class Segmenter(Protocol):
    def cut(self, text: str) -> list[str]: ...


class MaxMatch:
    """Longest known word first; runs of other scripts stay whole."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        self.lexicon, self.longest = lexicon, max(map(len, lexicon), default=1)

    def cut(self, text: str) -> list[str]:
        out = []
        for m in RUN.finditer(text):
            run, i = m[0], 0
            if not "㐀" <= run[0] <= "鿿":
                out.append(run)
                continue
            while i < len(run):
                n = next((n for n in range(min(self.longest, len(run) - i), 1, -1) if run[i : i + n] in self.lexicon), 1)
                out.append(run[i : i + n])
                i += n
        return out


#: Words of the queries that tests use; a deployment passes its own segmenter.
DEFAULT = MaxMatch(frozenset("今天 今日 昨天 昨日 前天 本周 上周 本月 这个月 图片 照片 图像 文档 文稿 机器 学习 自由女神 搜索 系统 识别 关于 查找 帮我 包含 含有 建筑 修改 创建 保存".split()))


def query_words(text: str, segmenter: Segmenter = DEFAULT) -> list[str]:
    """A query's words as an index has them: reserved characters and operator words gone, terms' parts apart."""
    found = " ".join(segmenter.cut(apart(text.translate(_BLANKED)))).split()
    return [w for w in found if w.isalnum() and w.lower() not in OPERATORS]
