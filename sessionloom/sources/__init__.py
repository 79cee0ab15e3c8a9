"""Session-log sources: file listing, line framing, format import and raw text scans."""
