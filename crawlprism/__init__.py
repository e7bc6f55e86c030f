"""crawlprism: compare browsing profiles in web-crawl measurements with Spark DataFrames."""

from crawlprism.config import Study

__all__ = ["Study"]
