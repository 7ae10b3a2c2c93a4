"""Where data comes from and goes to: files, converters behind injected clients, snapshot tables, scopes, HTML."""
