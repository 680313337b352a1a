"""Plain definitions of the metrics, as slow as they are short."""

import math
import re
from collections import Counter


def rouge_tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def prf(hits, made, asked):
    p, r = hits / max(made, 1), hits / max(asked, 1)
    return p, r, (2 * p * r / (p + r) if hits else 0.0)


def rouge_n(predicted, gold, n):
    a, b = grams(rouge_tokens(predicted), n), grams(rouge_tokens(gold), n)
    return prf(sum((a & b).values()), sum(a.values()), sum(b.values()))


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def rouge_l(predicted, gold):
    a, b = rouge_tokens(gold), rouge_tokens(predicted)
    return prf(table(a, b)[-1][-1], len(b), len(a))


def walk(a, b):
    t, i, j, out = table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def rouge_lsum(predicted, gold):
    made = [rouge_tokens(line) for line in (predicted or "").split("\n")]
    asked = [rouge_tokens(line) for line in (gold or "").split("\n")]
    free = Counter(t for line in made for t in line)
    hits = 0
    for line in asked:
        for i in set().union(*[walk(line, other) for other in made]):
            if free[line[i]] > 0:
                free[line[i]] -= 1
                hits += 1
    return prf(hits, sum(map(len, made)), sum(map(len, asked)))


def bleu_tokens(text):
    line = (text or "").replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    line = re.sub(r"([\x7b-\x7e\x5b-\x60\x20-\x26\x28-\x2b\x3a-\x40\x2f])", r" \1 ", line)
    line = re.sub(r"([^0-9])([.,])", r"\1 \2 ", line)
    line = re.sub(r"([.,])([^0-9])", r" \1 \2", line)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", line).split()


def bleu(pairs):
    match, total, made, asked = [0] * 4, [0] * 4, 0, 0
    for predicted, gold in pairs:
        a, b = bleu_tokens(predicted), bleu_tokens(gold)
        made, asked = made + len(a), asked + len(b)
        for n in range(4):
            match[n] += sum((grams(a, n + 1) & grams(b, n + 1)).values())
            total[n] += max(len(a) - n, 0)
    shares = [m / t if t else 0.0 for m, t in zip(match, total)]
    if not made or not asked or min(shares) == 0:
        return 0.0
    ratio = made / asked
    return math.exp(sum(map(math.log, shares)) / 4) * (1.0 if ratio > 1 else math.exp(1 - 1 / ratio))
