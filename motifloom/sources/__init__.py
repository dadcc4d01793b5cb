"""Readers of sequences, motifs, sites, modules, trees and backgrounds."""
