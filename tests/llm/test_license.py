"""License scans of long lines, of wrapped and neighbouring notices, and of small differences."""

import random
import textwrap

import pytest

from tessera.llm import license_scan

FILLER = [f"word{i * 7919 % 10007} of the river{i}" for i in range(20_000)]


@pytest.mark.parametrize("size", [100, 4_400, 8_700, 13_000, 200_000])
@pytest.mark.parametrize("k", range(len(license_scan.TEMPLATES)))
def test_a_notice_in_a_line_of_any_length(size, k):
    name, text = license_scan.TEMPLATES[k]
    filler = " ".join(FILLER)
    found = license_scan.identify(f"{filler[: size // 2]} {text} {filler[size // 2 : size]}")
    assert found and found.license == name and not found.missing_words and not found.extra_words


@pytest.mark.parametrize("k", range(len(license_scan.TEMPLATES)))
def test_wrapped_notices_are_found(k):
    name, text = license_scan.TEMPLATES[k]
    wrapped = "intro\n" + "\n".join(f"# {line}" for line in textwrap.wrap(text, 30, break_on_hyphens=False, break_long_words=False)) + "\nend"
    [(start, end, found)] = license_scan.notices(wrapped)
    assert found.license == name and license_scan.wording(wrapped[start:end]) == license_scan.wording(text)


def test_every_notice_of_a_line_is_found(spark):
    line = " or ".join(t for _, t in license_scan.TEMPLATES)
    rows = license_scan.scan(spark.createDataFrame([(1, "first\n" + line)], "doc_id long, text string")).collect()
    assert [r["license"] for r in rows] == [n for n, _ in license_scan.TEMPLATES] and {r["line"] for r in rows} == {1}


def test_small_differences():
    mit, gpl = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[6][1]
    found = license_scan.identify(mit.replace("any person", "every person"))
    assert found.license == "MIT" and (found.missing_words, found.extra_words) == (1, 1)
    assert license_scan.identify(gpl.replace("GNU General", "GNU Lesser General")) is None and license_scan.identify(gpl.replace("version 3", "version 2")) is None


def planted(n=240):
    rng = random.Random(11)
    for i in range(n):
        k = i % len(license_scan.TEMPLATES)
        name, text = license_scan.TEMPLATES[k]
        words = text.split()
        if len(words) >= 40 and i % 5:  # a difference that tells nothing apart
            p = next(p for p in rng.sample(range(len(words)), len(words)) if words[p].isalpha() and words[p].lower() not in license_scan.TELLING and not license_scan._CUE.search(words[p]))
            words[p] = rng.choice(["some", words[p] + "s"])
        a = rng.randrange(len(FILLER) - 400)
        yield k, name, " ".join(FILLER[a : a + rng.randrange(200)]), " ".join(words), " ".join(FILLER[a + 200 : a + 200 + rng.randrange(200)])


def test_planted_and_perturbed_notices_are_found():
    for k, name, before, text, after in planted():
        [(x, y, found)] = license_scan.notices(f"{before} {text} {after}")
        assert (found.license, found.template) == (name, k) and x == len(before) + 1


def test_the_ranking_alone_finds_the_license():
    """The template with the largest reduction of the block around a notice is of its license in nine of ten cases."""
    right = 0
    for _, name, before, text, after in planted():
        block = " ".join(license_scan.wording(before)[-60:] + license_scan.wording(text) + license_scan.wording(after)[:60])
        right += license_scan.TEMPLATES[license_scan.ranked(f" {block} ", license_scan.TEMPLATES, 6)[0][0]][0] == name
    assert right >= 0.9 * 240


def test_wrong_sizes_give_wrong_notices(monkeypatch):
    """Where several templates agree the compression decides between them."""
    cases = [(k, f"{before} {text} {after}") for k, _, before, text, after in planted()]
    assert all(license_scan.notices(t)[0][2].template == k for k, t in cases)
    right = license_scan.ranked.__wrapped__
    monkeypatch.setattr(license_scan, "ranked", lambda *a: [(k, small, plain) for k, plain, small in right(*a)[::-1]])
    wrong = [license_scan.notices(t) for _, t in cases]
    assert sum(f[0][2].template != k for (k, _), f in zip(cases, wrong, strict=True)) > 5


@pytest.mark.parametrize(
    "text",
    [
        "She asked for permission to copy the keys and was granted it without a fee.", "The driver's license had expired in version 3 of the story.", "You may redistribute the cakes among the children in binary baskets.",
        "Free software meets on Tuesday; creative commons people on Friday.", "Licensed to drive, licensed to sell, licensed to fish, licence revoked.", "CC BY the way, we leave at 4.0 sharp.",
        "This work is licensed under no terms at all.", "Permission is hereby granted to leave early, provided that the notice appears on the door.", "The MIT License is discussed in chapter two, the Apache License in chapter three.", "license " * 3000,
    ],
)
def test_prose_about_licenses_is_no_notice(text):
    assert license_scan.notices(text) == []


def test_equal_reductions_and_repeated_notices():
    """Ties go to the earlier template; each repetition is a notice of its own."""
    text = license_scan.TEMPLATES[0][1]
    twice = license_scan.TEMPLATES + (("Other", text),)
    assert [f.license for _, _, f in license_scan.notices(f"{text} and {text}", templates=twice)] == ["MIT", "MIT"]
