"""Model outputs and judge outputs: cleaning, score parsing, relative and rule-based scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from obliva.functions import logits as L
from obliva.functions.attributes import ATTRIBUTES

EMPTY = "[EMPTY]"
#: Score of an output that could not be parsed.
UNPARSED = -1.0
#: Line ends as Python's str.splitlines knows them.
_LINE = "\\r\\n|[\\n\\u000b\\u000c\\r\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"


def wrap(question: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), question, F.lit(end))


def qa_text(question: Column, answer: Column, start: str, end: str) -> Column:
    return F.concat(wrap(question, start, end), F.lit(" "), answer)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_spans(text: Column, start: str, end: str) -> Column:
    """Without complete start...end spans, until none is left.

    A pass leaves spans only where it joins pieces of markers; each takes a start marker away, so there are no more
    passes than first characters of one in the text.
    """
    pattern = f"(?s){re.escape(start)}.*?{re.escape(end)}"

    def of(t: Column) -> Column:
        most = F.length(t) - F.length(F.replace(t, F.lit(start[0]), F.lit("")))
        return L.let(most, lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), t, lambda x, _: F.regexp_replace(x, pattern, ""))).otherwise(t))

    return L.let(text, of)


def cut_open_span(text: Column, start: str, end: str) -> Column:
    """Without what follows the last start marker, if there are more start than end markers."""

    def count(t: Column, mark: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)

    def of(t: Column) -> Column:
        before = L.let(F.split(t, re.escape(start), -1), lambda x: F.array_join(F.slice(x, F.lit(1), F.size(x) - 1), start))
        return F.when(count(t, start) > count(t, end), strip(before)).otherwise(t)

    return L.let(text, of)


def drop_orphans(text: Column, start: str, end: str) -> Column:
    s, e = re.escape(start), re.escape(end)
    #: Fixed value: a start marker with no end marker before it, an end marker with no start marker after it.
    return F.regexp_replace(text, f"(?i)(?<!{e}){s}|{e}(?!{s})", "")


def drop_echo(text: Column, prompt: Column) -> Column:
    """Without the prompt's own words, wherever they come back, if they are more than 5 characters."""

    def of(bare: Column) -> Column:
        quoted = F.concat(F.lit("(?i)\\s*\\Q"), F.replace(bare, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\s*"))
        return F.when(F.length(bare) > 5, F.regexp_replace(text, quoted, F.lit(""))).otherwise(text)

    return L.let(strip(prompt), of)


def repeat_collapser():
    """A function of a text that does what the regular expression of collapse_repeats does, in about n log n steps.

    Without white space, three repeats in a row are a run of a period p at least 3p long.  Such a run holds two equal
    neighbours among the blocks of p characters, so the runs of all periods are found by comparing block hashes.  Where
    a run allows it, the expression's own choice is taken: the longest group first, then as many repeats as follow.
    All is local here, so that executors need nothing but numpy.
    """

    def word_flags(text: str) -> list[bool]:
        """What \\b of Java 17 takes for parts of words."""
        from unicodedata import category

        flags, based = [], False
        for c in text:
            kind = "" if c.isascii() else category(c)
            based = (kind[0] == "L" or kind == "Nd" or (kind == "Mn" and based)) if kind else c.isalnum()
            flags.append(c == "_" or based)
        return flags

    def runs(chars, m: int) -> list[tuple[int, int, int]]:
        """(start, end, p) of the longest stretches of period p that are at least 3p long, over all p."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = (np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, 0xD1342543DE82EF95, np.uint64)]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(29))) * power[:m])])
            out = []
            for p in range(1, m // 3 + 1):
                part = total[::p]
                part = part[1:] - part[:-1]
                equal = np.flatnonzero(part[:-1] * power[p] == part[1:])
                if not len(equal):
                    continue
                breaks = np.flatnonzero(np.diff(equal) > 1) + 1
                for group in np.split(equal, breaks):
                    s, e = int(group[0]) * p, (int(group[-1]) + 1) * p
                    if chars[s:e] != chars[s + p : e + p]:
                        continue
                    low, high = 0, min(s, p)
                    while low < high:
                        k = (low + high + 1) // 2
                        low, high = (k, high) if chars[s - k : s] == chars[s - k + p : s + p] else (low, k - 1)
                    s -= low
                    low, high = 0, min(m - e - p, p)
                    while low < high:
                        k = (low + high + 1) // 2
                        low, high = (k, high) if chars[e : e + k] == chars[e + p : e + p + k] else (low, k - 1)
                    e += low + p
                    if e - s >= 3 * p:
                        out.append((s, e, p))
        return out

    def collapse(text: str | None) -> str | None:
        from heapq import heappop, heappush

        if text is None:
            return None
        n = len(text)
        at = [i for i, c in enumerate(text) if c not in BLANK]
        m = len(at)
        found = sorted(runs("".join([text[i] for i in at]), m))
        if not found:
            return text
        at.append(n)
        word = [False, *word_flags(text), False]
        edge = [word[i] != word[i + 1] for i in range(n + 1)]
        out, done, i, x, nxt = [], 0, 0, 0, 0
        live: list[tuple[int, int]] = []
        while i < n:
            while at[x] < i:
                x += 1
            while nxt < len(found) and found[nxt][0] <= x:
                heappush(live, (-found[nxt][2], found[nxt][1]))
                nxt += 1
            while live and x - 3 * live[0][0] > live[0][1]:
                heappop(live)
            if not live:
                if nxt == len(found):
                    break
                # To the white space before the next run, which a group may begin with.
                i = max(i + 1, at[found[nxt][0] - 1] + 1)
                continue
            end = match(text, at, edge, i, x, n, sorted(live)) if edge[i] else None
            if end:
                out += [text[done:i], text[i : end[0]]]
                done = i = end[1]
            else:
                i += 1
        return "".join([*out, text[done:]])

    def match(text, at, edge, i, x, n, live):
        """End of the group and of the whole match at i."""
        lead = at[x] - i
        last = 0
        for minus, e in live:
            p = -minus
            if p == last or x + 3 * p > e:
                continue
            last = p
            for j in dict.fromkeys((at[x + p], at[x + p - 1] + 1)):
                if not edge[j]:
                    continue
                group, k, times = text[i:j], j, 0
                while True:
                    start = k
                    while start < n and text[start] in BLANK:
                        start += 1
                    start -= lead
                    if start < k or not text.startswith(group, start):
                        break
                    k, times = start + len(group), times + 1
                if times >= 2:
                    return j, k
        return None

    BLANK = frozenset(" \t\n\x0b\f\r")
    return collapse


def _collapsed(text: Column) -> Column:
    #: Fixed value: the expression of three or more repeats in a row.
    return F.regexp_replace(text, r"(?s)(\b.+\b)(\s*\1){2,}", "$1")


def collapse_repeats(text: Column, longest: int = 2000) -> Column:
    """Three or more repeats in a row become one: by regular expression, whose cost is superlinear, up to ``longest`` characters, else by search."""
    short = F.length(text) <= longest
    searched = udf(repeat_collapser(), "string")(F.when(~short, text))
    return F.when(short, _collapsed(text)).otherwise(searched)


def tidy_lines(text: Column) -> Column:
    """Lines without white space at their ends, blank ones dropped; a mark if nothing is left."""
    lines = F.transform(F.split(text, _LINE), strip)
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), r"^\z", EMPTY)


def _unwrapped(output: Column, prompt: Column, start: str, end: str) -> Column:
    """The steps before repeats: each is computed once and bound, since most of them name their input several times."""
    bare = drop_spans(prompt, start, end)
    return L.let(cut_open_span(drop_spans(output, start, end), start, end), lambda x: L.let(drop_orphans(x, start, end), lambda y: drop_echo(y, bare)))


def cleaner(start: str, end: str):
    """A function of an output and its prompt that does all steps, as the expressions do them.  All is local here, as above."""
    collapse = repeat_collapser()
    lines, empty = _LINE, EMPTY
    # White space as Unicode has it, which the expressions' (?U) takes.
    blank = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def clean(output: str | None, prompt: str | None) -> str | None:
        import re

        if output is None:
            return None
        s, e = re.escape(start), re.escape(end)

        def without_spans(x: str) -> str:
            n = 1
            while n:
                x, n = re.subn(f"{s}.*?{e}", "", x, flags=re.S)
            return x

        text = without_spans(output)
        if text.count(start) > text.count(end):
            text = text[: text.rfind(start)].strip(blank)
        text = re.sub(f"(?<!{e}){s}|{e}(?!{s})", "", text, flags=re.I | re.A)
        bare = without_spans(prompt or "").strip(blank)
        if len(bare) > 5:
            text = re.sub(rf"\s*{re.escape(bare)}\s*", "", text, flags=re.I | re.A)
        kept = [x.strip(blank) for x in re.split(lines, collapse(text))]
        return "\n".join(x for x in kept if x) or empty

    return clean


def clean_output(output: Column, prompt: Column, start: str, end: str, longest: int = 2000) -> Column:
    """All steps in order.  Only outputs of over ``longest`` characters, whose repeats are searched for, leave the JVM, for all their steps."""
    short = F.length(output) <= longest
    whole = udf(cleaner(start, end), "string")(F.when(~short, output), F.when(~short, prompt))
    return F.when(short, tidy_lines(_collapsed(_unwrapped(output, prompt, start, end)))).otherwise(whole)


def parse_score(text: Column) -> Column:
    """The first "Rating: k" of a judge's output, 0 to 10, to one place; UNPARSED if there is none."""
    ascii_ = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]+", ""), r"\s+", " "))
    #: Fixed value: the shapes of a rating.
    number = F.regexp_extract(ascii_, r"(?i)(Final\s+)?Rating:\s*(\[\[|\[)?([0-9]+(\.[0-9]+)?)(\]\]|\])?", 3)
    score = F.bround(F.nullif(number, F.lit("")).cast("double"), 1)
    return F.when(score.between(0.0, 10.0), score).otherwise(F.lit(UNPARSED))


def show_empty(text: Column) -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(EMPTY))


def judge_prompt(question: Column, answer: Column, reference: Column | None = None) -> Column:
    """System and user messages of a judgement, with or without a reference answer."""
    system = "You grade answers. Explain briefly, then end with 'Rating: [[k]]', k from 0 to 10."
    parts = [F.lit("Question: "), question]
    if reference is not None:
        parts += [F.lit("\nReference: "), show_empty(reference)]
    user = F.concat(*parts, F.lit("\nAnswer: "), show_empty(answer))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def flag_unparsed(text: Column, score: Column) -> Column:
    return F.when(score == UNPARSED, F.concat(text, F.lit(" [no score found]"))).otherwise(text)


def relative_score(model: Column, base: Column) -> Column:
    return F.bround(model - base, 2)


def rule_score(error: Column) -> Column:
    """10 for no error down to 1."""
    return F.bround(10 - error * 9, 1)


def final_score(attribute: Column, error: Column, judged: Column) -> Column:
    """The rule's score for attributes that have one, else the judge's."""
    return F.when(attribute.isin(*ATTRIBUTES), rule_score(error)).otherwise(judged)


def rule_note(attribute: Column, error: Column) -> Column:
    return F.format_string("%s by rule: error %.4f", attribute, error)


def garbled(text: Column, seed: str = "garbled") -> Column:
    """As many characters 0-255, drawn by hash: the bytes of one digest for each 16 characters, read as Latin-1."""
    key = F.md5(F.concat_ws("|", F.lit(seed), text).cast("binary"))
    n = F.char_length(text)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int"))).otherwise(F.array().cast("array<int>"))
    digests = F.array_join(F.transform(blocks, lambda i: F.md5(F.concat_ws("|", key, i.cast("string")).cast("binary"))), "")
    return F.when(text.isNotNull(), F.decode(F.unhex(F.substr(digests, F.lit(1), n * 2)), "ISO-8859-1"))
