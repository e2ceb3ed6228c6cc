"""Terms of a text, as the counting and scoring operators define them."""

from __future__ import annotations

import re

# Decimals with their dots, failing that runs of letters and digits that may be
# joined by one apostrophe or hyphen.  [^\W_] is Unicode L or N.
TERM = re.compile(r"\d+(?:\.\d+)+|[^\W_]+(?:['’\-][^\W_]+)*")


def terms(text: str | None) -> list[str]:
    """Lower-cased terms in reading order, ß written ss; none for a null or blank text.

    Terms are cut from the text as written and folded afterwards, because
    lower-casing first can turn one letter into a letter and a combining mark.
    """
    if not text:
        return []
    found = TERM.findall(text)
    if text.isascii():
        return "\n".join(found).lower().split("\n") if found else []
    return [t.lower().replace("ß", "ss") for t in found]
