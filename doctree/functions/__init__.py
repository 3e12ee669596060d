"""Column functions: slugs, paths, front matter, text and codecs."""
