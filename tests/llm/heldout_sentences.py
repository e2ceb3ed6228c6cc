"""Held-out precision and recall of sentence boundaries: python tests/llm/heldout_sentences.py [FOLDER].

The model learns from articles with odd numbers.  Of the others, the lines' first
sentences that are sure (up to the first terminator, which a blank, the line's end or
more Han script follows, behind a word of three letters or more) are joined five by
five; the joints are the true boundaries, once with their terminators, once without.
"""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from lexifold.llm import sentences as S  # noqa: E402

SURE = re.compile(rf"[^{S._ENDS}\n]{{12,}}[^\W\d_]{{3}}[{S._ENDS}](?=\s|$|[぀-ヿ㐀-鿿])")


def joined(texts, kind, marked, rnd):
    """Texts of five lines each with the places of their joints."""
    rnd.shuffle(texts)
    for k in range(0, len(texts) - 4, 5):
        pieces = [t if marked else t.rstrip(S._ENDS) for t in texts[k : k + 5]]
        blank = "" if kind == "Han" else " "
        ends, at = [], 0
        for p in pieces[:-1]:
            at += len(p)
            ends.append(at)
            at += len(blank)
        yield blank.join(pieces), set(ends)


def main(folder):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    articles = spark.read.parquet(f"{folder}/articles.parquet").filter("text_state = 'parsed'")
    model = S.fit(articles.filter("article_no % 2 = 1"), "article_no", ["abstract", "body"])
    lines = defaultdict(set)
    for row in articles.filter("article_no % 2 = 0").select("abstract", "body").collect():
        for text in row:
            for line in (text or "").splitlines():
                if m := SURE.match(line.strip()):
                    lines[S.script(line)].add(m.group())
    for kind, held in sorted(lines.items()):
        if kind == "Thai":
            continue
        for marked in (True, False):
            seen = Counter()
            for text, ends in joined(sorted(held), kind, marked, random.Random(1)):
                found = {b for _, b in S.spans(text, model)} - {len(text)}
                seen.update(true=len(ends), found=len(found), both=len(ends & found))
            if seen["true"]:
                print(kind, "with" if marked else "without", "terminators:", dict(seen), f"precision {seen['both'] / max(1, seen['found']):.3f} recall {seen['both'] / seen['true']:.3f}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:] or ["/root/testdata/sf0.1"])
