"""Spark jobs that keep wiki page trees and Markdown file trees consistent."""
