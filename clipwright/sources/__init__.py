"""Readers and writers of caption files, result documents, replies, requests and caches."""
