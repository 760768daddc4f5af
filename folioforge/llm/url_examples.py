"""A small labelled table of invented addresses, built by rule from short word lists."""

#: Words of hosts to be blocked, and words that go with them.
BLOCKED = ("casino", "poker", "slots", "jackpot", "bets", "lottery", "prize", "pills", "viagra", "cialis", "meds", "porn", "xxx", "adult", "sexy", "cams", "escort", "loans", "payday", "warez", "crack", "keygen", "replica", "spam", "ads", "track", "popup", "phish", "malware", "torrent")
BESIDE = ("win", "free", "cheap", "best", "online", "club", "farm", "x")
#: Words and syllables of ordinary hosts.
PLAIN = ("library", "museum", "university", "school", "garden", "recipes", "weather", "news", "travel", "science", "docs", "wiki", "forum", "music", "theatre", "art", "photo", "hiking", "railway", "hospital", "law", "statistics", "language", "poetry", "history", "maps", "physics", "birds", "kitchen", "market")
SYLLABLES = ("th", "er", "an", "on", "in", "re", "he", "nd", "st", "tion", "ing", "ou", "ea", "ble")
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = (".example.com", ".example.net", ".example.org", ".test")
LANGUAGES = ("en", "de", "fr", "es")
TAILS = ("", ".html", "/", "?page=2", "#top")


def _address(host: str, i: int) -> str:
    scheme = ("http", "https")[i % 2]
    return f"{scheme}://{PREFIXES[i % 4]}{host}{ENDINGS[i // 2 % 4]}/{LANGUAGES[i // 3 % 4]}/{(i * 7919) % 9973}{TAILS[i % 5]}"


def examples() -> list[tuple[str, int]]:
    """[(url, label)], label 1 is block; about 700 rows."""
    bad = [h for k, w in enumerate(BLOCKED) for s in (BESIDE[k % 8], BESIDE[(3 * k + 5) % 8]) for h in (w, f"{w}-{s}", f"{s}-{w}")]
    good = [h for k, w in enumerate(PLAIN) for h in (w, f"{w}-{PLAIN[(k + 7) % len(PLAIN)]}", f"{PLAIN[(k + 11) % len(PLAIN)]}-{w}")]
    good += [a + b for a in SYLLABLES for b in SYLLABLES] + [f"th{a}{b}" for a in SYLLABLES for b in SYLLABLES[::3]]
    return [(_address(h, i), 1) for i, h in enumerate(bad)] + [(_address(h, i), 0) for i, h in enumerate(good)]
