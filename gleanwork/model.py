"""Record shapes and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Settings and their defaults.
SETTING_DEFAULTS: dict[str, object] = {
    "search_on_web": False,
    "search_on_stack_overflow": False,
    "use_api": False,
    "github_api_key": None,
    "scraping_depth": 3,
    "scraping_max_pages": 100,
    "use_chrome": True,
    "use_firefox": False,
    "use_webkit": False,
}

# The two command words.
CODE_COMMAND = "getcode"
DOCS_COMMAND = "getcodedoc"

# Branches tried in this order.
BRANCH_CANDIDATES = ["main", "master", "latest"]

# Spellings that count as true.
TRUE_SPELLINGS = ["True", "true", "t", "1"]

# Address formats.
REPO_URL = "https://github.com/"
ARCHIVE_PATH = "/archive/refs/heads/"
RAW_FILE_URL = "https://raw.githubusercontent.com/"

# Texts shown to the user.
TEXT_NOT_FOUND = "Sorry I was unable to find any repository with the key: "
TEXT_DOWNLOAD = "Start downloading repository:"
TEXT_LIST = "I found the following libraries on github:"
TEXT_DONE = "All files have been ingested using %d threads, Miao!"
TEXT_NO_BROWSER = "please activate at least one browser engine"

SETTINGS_SCHEMA = T.StructType(
    [
        T.StructField("search_on_web", T.BooleanType()),
        T.StructField("search_on_stack_overflow", T.BooleanType()),
        T.StructField("use_api", T.BooleanType()),
        T.StructField("github_api_key", T.StringType()),
        T.StructField("scraping_depth", T.IntegerType()),
        T.StructField("scraping_max_pages", T.IntegerType()),
        T.StructField("use_chrome", T.BooleanType()),
        T.StructField("use_firefox", T.BooleanType()),
        T.StructField("use_webkit", T.BooleanType()),
    ]
)

RAW_SEARCH_SCHEMA = "payload STRUCT<results: ARRAY<STRUCT<hl_name: STRING>>>"
API_SEARCH_SCHEMA = "items ARRAY<STRUCT<full_name: STRING, html_url: STRING>>"

MESSAGE_SCHEMA = "msg_id STRING, msg STRING"
TIMED_MESSAGE_SCHEMA = "msg_id STRING, msg STRING, sent_at TIMESTAMP"
