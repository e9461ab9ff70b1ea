"""Fixed values that results depend on; stated as they must be, in natural order."""

# Query keys that a normalised URL drops.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "_ga", "_gid", "sessionid", "jsessionid", "phpsessid", "sid", "ref", "referrer")

# Endings of URLs that are never admitted.
IGNORED_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "mp3", "mp4", "avi", "mov")

# Endings and hosts of links that are never followed.
LINK_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "7z", "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "mp3", "mp4", "avi", "mov", "wmv", "flv", "css", "js", "ico", "xml", "rss")
LINK_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "google.com", "bing.com", "yahoo.com", "duckduckgo.com")

# Media types of pages, and the largest body in bytes.
MEDIA_TYPES = ("text/html", "text/plain", "text/xml", "application/xml", "application/xhtml+xml")
MOST_BYTES = 50 * 1024 * 1024

# Words that tell a page's type; the first type that matches counts.
NEWS = ("published", "reporter", "breaking", "news", "update")
BLOG = ("posted by", "author:", "blog", "opinion", "thoughts")
PRODUCT = ("price", "buy now", "add to cart", "product", "review")
DOCUMENTATION = ("documentation", "api", "tutorial", "guide", "how to")

# Frequent words of four languages, by which a text's language is told.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "den", "von", "das", "mit", "sich", "des", "auf", "nicht", "ist", "dem", "ein", "eine", "als", "auch", "für"),
    "en": ("the", "of", "and", "to", "that", "is", "was", "it", "for", "with", "he", "be", "on", "by", "at", "are", "this", "from"),
    "es": ("el", "los", "del", "las", "por", "con", "una", "su", "para", "al", "lo", "como", "más", "pero", "sus", "o", "y", "en"),
    "fr": ("le", "et", "les", "un", "du", "dans", "est", "pour", "qui", "au", "sur", "pas", "ne", "plus", "par", "je", "une", "elle"),
}

# English words that are no keywords.
STOP_WORDS = (
    "about above after again against because been before being below between both could does doing down during each from further have having here hers herself himself into itself just more most myself once only other ours ourselves over same should some such than that their theirs them themselves then there these they this those through under until very were what when where which while whom will with would your yours yourself yourselves"
).split()
