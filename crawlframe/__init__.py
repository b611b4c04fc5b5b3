"""crawlframe: web-crawl data work as Spark jobs over tables and streams."""

from crawlframe.config import CrawlConfig

__all__ = ["CrawlConfig"]
