"""Operators on documents, tokens, tags, vocabularies, features, trees and scores."""
