"""Paginated JSON as a Spark data source, and polite access to hosts.

``spark.dataSource.register(PagedJson)``, then
``spark.read.format("paged_json").option("start", url).load()``. Pages look like
``{"data": [...], "links": {"next": url or null}}``; each record is returned as JSON
text for ``from_json``. ``file://`` addresses are read as well as http(s).
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urljoin, urlparse
from urllib.request import urlopen
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader

MOST_PAGES = 400


class Refused(OSError):
    """A host refuses: robots.txt forbids the address, or it answers 429 or 503 to the end."""


class Polite:
    """One host at a time: robots.txt kept, a delay between requests, retries with back-off, caps on all of them.

    ``fetch`` raises ``HTTPError`` for a status and ``OSError`` for a lost connection. 429
    and 503 are waited out, by Retry-After if it is given; other statuses of 400 or more
    are not asked again. An address of http that cannot be reached is tried with https.
    """

    FLOOR_S, CAP_S, TRIES, AGENT = 2.0, 30.0, 3, "*"

    def __init__(self, fetch: Callable[[str], bytes], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, robots: bool = False):
        self.fetch, self.sleep, self.clock, self.robots = fetch, sleep, clock, robots
        self.last: dict[str, float] = {}
        self.rules: dict[str, RobotFileParser] = {}

    def _rules(self, url: str) -> RobotFileParser:
        root = "{0.scheme}://{0.netloc}".format(urlparse(url))
        if root not in self.rules:
            self.rules[root] = rules = RobotFileParser()
            try:
                rules.parse(self._wait_and_fetch(f"{root}/robots.txt", self.FLOOR_S).decode("utf-8", "replace").splitlines())
            except HTTPError as e:  # 401 and 403 close a host, other answers leave it open
                rules.disallow_all, rules.allow_all = e.code in (401, 403), e.code not in (401, 403)
            except OSError:
                rules.allow_all = True
        return self.rules[root]

    def _wait_and_fetch(self, url: str, wait: float) -> bytes:
        host = urlparse(url).netloc
        gap = self.last.get(host, -1e9) + wait - self.clock()
        if gap > 0:
            self.sleep(min(self.CAP_S, gap))
        try:
            return self.fetch(url)
        finally:
            self.last[host] = self.clock()

    def get(self, url: str, delay: float = 0.0) -> bytes:
        web = urlparse(url).scheme in ("http", "https")
        if web and self.robots:
            rules = self._rules(url)
            if not rules.can_fetch(self.AGENT, url):
                raise Refused(f"robots.txt forbids {url}")
            delay = max(delay, float(rules.crawl_delay(self.AGENT) or 0))
        wait = min(self.CAP_S, max(self.FLOOR_S, delay)) if urlparse(url).netloc else 0.0
        for attempt in range(self.TRIES):
            try:
                return self._wait_and_fetch(url, min(self.CAP_S, wait * 2**attempt))
            except HTTPError as e:
                if e.code not in (429, 503):
                    raise
                if attempt == self.TRIES - 1:
                    raise Refused(f"{e.code} from {url}") from e
                after = str((e.headers or {}).get("Retry-After", ""))
                self.sleep(min(self.CAP_S, float(after) if after.isdigit() else wait * 2**attempt))
            except OSError:
                if attempt == self.TRIES - 1:
                    if url.startswith("http://"):
                        return self._wait_and_fetch("https://" + url.removeprefix("http://"), wait)
                    raise
        raise AssertionError


def _fetch(url: str) -> bytes:
    with urlopen(url, timeout=30) as r:
        return r.read()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.most = options["start"], int(options.get("pages", MOST_PAGES))

    def read(self, partition) -> Iterator[tuple]:
        get, url, page = Polite(_fetch).get, self.start, 0
        seen: set[str] = set()
        while url and page < self.most and url not in seen:
            seen.add(url)
            payload = json.loads(get(url))
            for i, record in enumerate(payload.get("data") or []):
                yield page, i, json.dumps(record, ensure_ascii=False)
            following = (payload.get("links") or {}).get("next")
            url = urljoin(url, following["href"] if isinstance(following, dict) else following) if following else None
            page += 1


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, position int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def pool_size(exists: Callable[[int], bool], most: int = 1 << 20) -> int:
    """How many offsets exist, by doubling and halving: about 2 log2(n) probes."""
    if not exists(0):
        return 0
    lo, hi = 0, 1
    while hi < most and exists(hi):
        lo, hi = hi, hi * 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if exists(mid) else (lo, mid)
    return lo + 1


def draw_offsets(size: int, n: int, seed: int) -> list[int]:
    """``n`` different offsets below ``size``, the same for the same seed."""
    return sorted(random.Random(seed).sample(range(size), min(n, size)))


class TooLarge(ValueError):
    """A body beyond the cap."""


def download(url: str, chunks: Callable[[str], Iterator[bytes]], store: Callable[[str, bytes], None], known: set[str], most: int = 100 << 20) -> tuple[str, int, bool]:
    """(sha256, size, whether it is new) of a body read piece by piece, hashed as it comes and stored by its hash.

    The first body of a hash wins; beyond ``most`` bytes it is given up. ``known`` holds
    the hashes stored before and is added to.
    """
    digest, parts, size = hashlib.sha256(), [], 0
    for piece in chunks(url):
        size += len(piece)
        if size > most:
            raise TooLarge(f"more than {most} bytes at {url}")
        digest.update(piece)
        parts.append(piece)
    name = digest.hexdigest()
    new = name not in known
    if new:
        store(name, b"".join(parts))
        known.add(name)
    return name, size, new
