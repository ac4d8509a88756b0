"""Requests that depend on each other, against one after the other."""

import random

import pytest

from agora.operators import ordered, settling
from agora.plans import merge
from agora.plans.audit import EMAIL_TAKEN, USERNAME_TAKEN

LINKS = "seq long, up long, yes boolean, no boolean, value boolean"
SIGN_UP = "seq long, id long, username string, email string, display_name string, created_at timestamp_ntz"
EDIT = "seq long, actor_id long, id long, display_name string, email string"


def test_long_chains_take_logarithmic_rounds(spark):
    rows = [(0, None, None, None, True)] + [(k, k - 1, False, True, None) for k in range(1, 10_000)]
    values, rounds = settling.follow(spark.createDataFrame(rows, LINKS).repartition(4))
    assert {r.seq: r.value for r in values.collect()} == {k: k % 2 == 0 for k in range(10_000)}
    assert rounds <= 15


def test_open_rows_keep_what_hangs_on_them_open(spark):
    rows = [(1, None, None, None, None), (2, 1, True, False, None), (3, 2, False, True, None), (4, 3, True, True, None), (5, None, None, None, False), (6, 5, True, False, None)]
    values, _ = settling.follow(spark.createDataFrame(rows, LINKS))
    found = {r.seq: r.value for r in values.collect()}
    assert found[2] is None and found[3] is None and found[6] is False


def test_last_value_across_blocks(spark):
    rows = [("a", k, k if k % 7 == 0 else None) for k in range(-20, 100)] + [("b", 3, None), ("b", 50, 5), ("b", 99, None)]
    found = ordered.with_last(spark.createDataFrame(rows, "k string, seq long, v long"), ["k"], "seq", "v", "last", block=10)
    got = {(r.k, r.seq): r["last"] for r in found.collect()}
    for key, seq, _ in rows:
        before = [v for k, s, v in rows if k == key and s < seq and v is not None]
        assert got[key, seq] == (before[-1] if before else None)


def sign_ups(spark, rows):
    return spark.createDataFrame([(s, s + 1000, name, email, "x", None) for s, name, email in rows], SIGN_UP).repartition(3)


def plain_sign_ups(rows, names, emails):
    names, emails, out = {n.lower() for n in names}, {e.lower() for e in emails}, []
    for seq, name, email in sorted(rows):
        taken = [m for m, t in ((USERNAME_TAKEN, name.lower() in names), (EMAIL_TAKEN, email.lower() in emails)) if t]
        out.append((seq, "; ".join(taken) or None))
        if not taken:
            names.add(name.lower())
            emails.add(email.lower())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sign_ups_one_after_the_other(spark, world, seed):
    rng = random.Random(seed)
    world.user("stored")
    tables = world.tables()
    rows = [(k, rng.choice(["stored", f"n{rng.randrange(12)}", f"N{rng.randrange(40)}"]), f"e{rng.randrange(30)}@x.com") for k in range(60)]
    merged = merge.create_users(tables, sign_ups(spark, rows))
    want = plain_sign_ups(rows, ["stored"], ["stored@somewhere.com"])
    assert sorted((r.seq, r.reason) for r in merged.outcomes.collect()) == want
    assert merged.table.count() == 1 + sum(reason is None for _, reason in want)


def test_a_chain_of_shared_names(spark, world, monkeypatch):
    """Each request shares its name with the one before or its email with the one after."""
    world.user("stored")
    rows = [(k, f"n{k // 2}", f"e{(k + 1) // 2}@x.com") for k in range(600)]
    calls = []
    plain = merge.follow
    monkeypatch.setattr(merge, "follow", lambda links: calls.append(1) or plain(links))
    merged = merge.create_users(world.tables(), sign_ups(spark, rows))
    assert sorted((r.seq, r.reason) for r in merged.outcomes.collect()) == plain_sign_ups(rows, [], [])
    assert len(calls) <= 2


def plain_edits(rows, emails):
    """``emails``: the email of each user before; requests (seq, user, email) in order."""
    emails, out = dict(emails), []
    for seq, user, email in sorted(rows):
        bad = "@" not in email
        taken = any(e == email.lower() and u != user for u, e in emails.items())
        reason = [m for m, t in (("Email is invalid", bad), (EMAIL_TAKEN, taken)) if t]
        out.append((seq, "; ".join(reason) or None))
        if not reason:
            emails[user] = email.lower()
    return out, emails


def edited(spark, tables, rows):
    batch = spark.createDataFrame([(s, u, u, None, e) for s, u, e in rows], EDIT).repartition(3)
    return merge.edit_users(tables, batch)


def users_of(world, n):
    return {world.user(f"u{k}", email=f"u{k}@x.com"): f"u{k}@x.com" for k in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_emails_one_after_the_other(spark, world, seed, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 17)
    rng = random.Random(seed)
    emails = users_of(world, 8)
    pool = [*emails.values(), "A@x.com", "b@x.com", "c@x.com", "broken"]
    rows = [(k * 3, rng.choice(list(emails)), rng.choice(pool)) for k in range(70)]
    merged = edited(spark, world.tables(), rows)
    want, after = plain_edits(rows, emails)
    assert sorted((r.seq, r.reason) for r in merged.outcomes.collect()) == want
    assert {r.id: r.email for r in merged.table.collect()} == after


@pytest.mark.parametrize("first", ["free@x.com", "u0@x.com"])
def test_a_chain_of_freed_emails(spark, world, first, monkeypatch):
    """The last user moves away, or fails to, and each one before takes what the next has left."""
    emails = users_of(world, 60)
    ids = list(emails)
    rows = [(k, ids[-1 - k], first if k == 0 else emails[ids[-k]]) for k in range(59)]
    calls = []
    plain = merge.follow
    monkeypatch.setattr(merge, "follow", lambda links: calls.append(1) or plain(links))
    merged = edited(spark, world.tables(), rows)
    want, after = plain_edits(rows, emails)
    assert sorted((r.seq, r.reason) for r in merged.outcomes.collect()) == want
    assert all((reason is None) == (first == "free@x.com") for _, reason in want)
    assert {r.id: r.email for r in merged.table.collect()} == after
    assert len(calls) <= 3


def test_one_email_that_everybody_asks_for(spark, world):
    emails = users_of(world, 40)
    rows = [(k, u, "hot@x.com") for k, u in enumerate(emails)] + [(100, list(emails)[0], "other@x.com"), (101, list(emails)[7], "HOT@x.com")]
    merged = edited(spark, world.tables(), rows)
    assert sorted((r.seq, r.reason) for r in merged.outcomes.collect()) == plain_edits(rows, emails)[0]


def test_confirmations(spark, world):
    user = world.user()
    found = merge.confirmations(world.tables(), spark.createDataFrame([(user, None), (99, None)], "id long, confirmed_at timestamp_ntz"))
    assert {r.id: r.reason for r in found.collect()} == {user: None, 99: merge.UNKNOWN_USER}


def test_no_requests(spark, world):
    world.user()
    tables = world.tables()
    assert merge.edit_users(tables, spark.createDataFrame([], EDIT)).outcomes.count() == 0
    assert merge.create_users(tables, spark.createDataFrame([], SIGN_UP)).outcomes.count() == 0
