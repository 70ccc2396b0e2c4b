"""What counts as a secret in text. Written for both regex dialects in use."""

KEY_NAME = r"(?:[A-Za-z_][\w-]*[_-])?(?:api[_-]?key|secret|token|password)"
ASSIGNED = r"(?<![\w-])(?:[\"']?" + KEY_NAME + r"[\"']?)[ \t]*[:=][ \t]*"
# runs of plain characters are taken whole, so that a long value needs no deep matching stack
QUOTED = r"(?i)(" + ASSIGNED + r")([\"'])(?:(?<=\")(?:[^\"\r\n\\]++|\\[^\r\n])++|(?<=')(?:[^'\r\n\\]++|\\[^\r\n])++)\2"
TRIPLE = r"(?is)" + ASSIGNED + r"(\"{3}|'{3}).*?\1"
BARE = r"(?i)(" + ASSIGNED + r")(\[REDACTED\]|[^\s,\"'\)\]\}]+)"
API_KEY = r"\bsk-[A-Za-z0-9_-]{12,}\b"
KEY_BLOCK = r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?(?:-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|(?![\s\S]))"
CONFIG_NAME = r"(?i)(^|/)(\.env[^/]*|[^/]*\.(env|ini|cfg|properties|yaml|yml|toml))$"
URL = r"(?i)https?://[^\s\"'<>]+"
BEARER = r"(?i)\b(?:Bearer|Basic)\s+[^\s\"',;]+"
MASK = "[REDACTED]"
SENSITIVE_KEYS = ("authorization", "api_key", "apikey", "password", "secret", "access_token", "refresh_token")
HIDDEN_KEYS = ("reasoning_content", "encrypted_content", "provider_items")
