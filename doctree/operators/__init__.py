"""Jobs over page trees, links, attachments and snapshots: tables in, tables out."""
