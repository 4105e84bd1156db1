"""Every message that a rejected value carries."""

# Messages that callers match.
TITLE = "document title may not be empty"
FIELD = "{} may not be empty"
NOTE = "empty revision note"
CONTENT = "{} content must include at least one non-empty segment"
SEGMENT = "{} segments may not be empty"
SPEAKER = "speaker references must not be empty"
CONTAINER_ID_EMPTY = "{} identifiers must not be empty"
CONTAINER_ID_SPACE = "{} identifiers must not contain whitespace"
ID_EMPTY = "identifiers must not be empty"
ID_SPACE = "identifiers must not contain whitespace"
XML = "XML processing error: "
FORBIDDEN = "document contains XML 1.0 forbidden character "
INLINE = "data did not match any variant of untagged enum Inline"
UNCLOSED = "start tag not closed"

#: Names of the required header fields, as they stand in FIELD.
SPEAKER_NAME, LANGUAGE, SYSTEM, RESPONSIBLE, REVISION = "speaker", "language", "annotation system", "revision responsibility", "revision note"
