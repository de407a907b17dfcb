"""Tables, text trees and benchmark samples as DataFrames."""
