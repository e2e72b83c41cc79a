"""Labelled documents for learning what running prose is: made here from sentence frames, none taken from any corpus."""

from __future__ import annotations

import random
import re

#: Forms in tables of pronouns and verbs.
FORMS = "i you he she we they my your his our their who which whom this that these those is was were has have can may must should do does did been be".split()

#: Frames of sentences: N a noun, A an adjective, V a verb, P a place. English of rising difficulty, then other languages.
FRAMES = """I have a A N and my brother has two N.
She goes to the P every day because she likes the N.
We were at the P when it began to rain.
There is a N in the P, but nobody can see it.
Do you know the A N that lives near the P?
Yesterday my family V the N and then we V some N.
You should not V a N if you do not want to V it.
He said that he would V the N after the holidays.
What I like about this P is that the N are A and A.
Although the N was A, we decided to V it again.
If more people V their N, they could V the A N of the P.
It is often said that N are more A than N, which I cannot believe.
Many A N have been V by those who work in the P.
One of the reasons for this N is that it makes the P less A.
The A N of modern P, which has been V for years, remains a matter of debate.
Not only does the N V the P, it also leads to A N.
To what extent a A N might V such N is a question that experts have avoided.
They do not think about the N; they just V it.
Ich habe ein N und meine Schwester hat auch einen N.
Wir waren am Wochenende in der P, weil das Wetter schön war.
Der Lehrer sagt, dass man jeden Tag etwas über das N lesen soll.
Wenn ich Zeit habe, gehe ich mit meinem Freund in die P.
J'ai un N et ma soeur a une N dans la P.
Nous avons V le N parce que il est très A.
Mi hermano tiene un N y yo no he visto la P.
Cuando era pequeño, mi familia y yo fuimos a la P.
Non ho mai visto il N che è nella P.
Quando sono a casa, mio fratello ed io siamo con gli N.""".split("\n")

ONSETS, NUCLEI, CODAS = "b br c cl d dr f g gr h l m n p pl r s st t tr v w".split(), "a e i o u ea ou ai".split(), ["", "n", "r", "l", "st", "ment", "tion", "er", "ing", "ous"]


def _word(dice: random.Random) -> str:
    return "".join(dice.choice(ONSETS) + dice.choice(NUCLEI) for _ in range(dice.choice((1, 1, 2, 2, 3)))) + dice.choice(CODAS)


def _prose(dice: random.Random, words: int) -> str:
    frames = FRAMES[: dice.choice((9, 13, 18))] if dice.random() < 0.75 else dice.choice((FRAMES[18:22], FRAMES[22:24], FRAMES[24:26], FRAMES[26:28]))
    out: list[str] = []
    while sum(len(s.split()) for s in out) < words:
        out.append(" ".join(_word(dice) + x[1:] if x[0] in "NAVP" and not x[1:].strip(".,;?") else x for x in dice.choice(frames).split()))
    text = dice.choice((" ", " ", " ", "\n")).join(out)
    how = dice.random()
    if how < 0.15:
        text = "".join(c for c in text.lower() if c not in ".,;?")
    elif how < 0.3:
        parts = text.split(" ")
        text = "".join(w + ("\n" if i % 7 == 6 else " ") for i, w in enumerate(parts))
    return text


def _junk(dice: random.Random, words: int) -> str:
    kind = dice.choice((0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 10, 11, 11, 12))
    pick = lambda n=1: " ".join(_word(dice) for _ in range(n))
    bullet = dice.choice(("- ", "* ", "• ", "+ ", "-> ", "", "# ", "o ", "a) "))
    rows: list[str] = []
    bag = _prose(dice, words + 20).lower().replace(".", "").split() if kind == 11 else []
    dice.shuffle(bag)
    gap = dice.choice((" | ", "\t", ", ", "   ", " - "))
    while sum(map(_size, rows)) < words:
        if kind == 11:
            n = dice.choice((1, 2, 3, 4, 5))
            rows.append(bullet + " ".join(bag[:n]))
            bag = bag[n:] or ["the"]
        elif kind == 12:
            rows.append(gap.join((dice.choice(FORMS), pick(), pick(), dice.choice(FORMS))))
        elif kind == 0:
            rows.append(bullet + pick(dice.choice((1, 1, 2, 3))))
        elif kind == 1:
            rows.append(f"{len(rows) + 1}. {pick(dice.choice((1, 2, 3)))}")
        elif kind == 2:
            rows.append(f"{pick()} {dice.choice('=-:')} {pick()}")
        elif kind == 3:
            rows.append("| " + " | ".join([pick(), *(str(dice.randrange(40)) for _ in range(4))]) + " |")
        elif kind == 4:
            rows.append(";".join([pick(), f"{dice.choice('ABC')}{dice.randrange(3)}", str(dice.random())[:4], pick()]))
        elif kind == 5:
            rows.append(" ".join("".join(dice.choice("bcdfghjklmnpqrstvwxz") for _ in range(dice.randrange(2, 12))) for _ in range(8)))
        elif kind == 6:
            rows.append("%032x" % dice.getrandbits(128))
        elif kind == 7:
            rows.append(" ".join([pick(), dice.choice(("###", "<3", "***", ":-)", "~~~", ">>>")), dice.choice(("///", "+++", "---"))]))
        elif kind == 8:
            rows.append(pick(12))
        elif kind == 9:
            form = dice.choice(("a {} and a {}", "the {} of the {}", "my {} and his {}", "{} but not {}", "in the {}", "to {} by the {}", "with a {}", "after the {}", "near the {}", "ein {} und eine {}", "in der {}"))
            rows.append(bullet + form.format(pick(), pick()))
        else:
            rows.append(f"{dice.choice(('Mon', 'Tue', 'Fri'))} {dice.randrange(8, 19)}:{dice.choice(('00', '15', '30'))}  {pick()}  {pick()} {dice.randrange(90)}")
    between = "\n" if kind not in (7, 8, 9, 11) or dice.random() < 0.6 else dice.choice((" / ", "; ", ", ", " | ") if kind != 11 else (" ",))
    return between.join(rows)


def _size(text: str) -> int:
    return len(re.findall(r"[^\W_]+", text))


def labelled(size: int = 3000, seed: int = 11) -> tuple[list[str], list[bool]]:
    """`size` texts and whether less than half of each is running prose, in words. Texts close to the half are left out."""
    dice = random.Random(seed)
    texts, junk = [], []
    while len(texts) < size:
        words = dice.choice((20, 40, 80, 150, 250))
        share = dice.choice((0.0, 0.0, 1.0, 1.0, dice.uniform(0.0, 0.4), dice.uniform(0.6, 1.0)))
        parts = [_prose(dice, round(words * share))] if share * words >= 5 else []
        prose = sum(map(_size, parts))
        if (1 - share) * words >= 4:
            parts.append(_junk(dice, round(words * (1 - share))))
        dice.shuffle(parts)
        real = prose / max(1, sum(map(_size, parts)))
        if 0.4 <= real <= 0.6 or not parts:
            continue
        texts.append("\n".join(parts))
        junk.append(real < 0.5)
    return texts, junk
